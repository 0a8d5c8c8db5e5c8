"""Secret scan: keywords by one Aho-Corasick pass, anchored expressions only where a keyword
stands, embedded checksums last.

A kind without a keyword (runs of hex digits) is anchored by sampled characters: a run of 24
covers six sampled places in a row when every fourth character is looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from waymesh.llm.common import id_and_text, map_rows

# Kinds in the order they are listed, keywords, expressions, least lengths.
BASE_KINDS = ("assign", "access", "hex")
KINDS = BASE_KINDS + ("github", "npm", "xkey")
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "api_key": "assign",
    "apikey": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
    "xprv": "xkey",
}
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
XKEY = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

STRIDE = 4
SAMPLED_HEX = re.compile(r"[0-9a-f]{%d,}" % (LEAST_HEX // STRIDE))
_HEX_DIGITS = frozenset("0123456789abcdef")
_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}

Span = tuple[int, int, str]


def base62_crc(payload: str) -> str:
    """CRC-32 of ``payload`` as six base-62 digits."""
    value, digits = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def has_base62_crc(token: str) -> bool:
    """Whether the last six characters are the checksum of those after the prefix."""
    return base62_crc(token[4:-6]) == token[-6:]


def has_base58_check(token: str) -> bool:
    """Whether the last four bytes are the double SHA-256 of those before."""
    value = 0
    for letter in token:
        value = value * 58 + BASE58.index(letter)
    raw = value.to_bytes(82, "big") if value.bit_length() <= 656 else b""
    return len(raw) == 82 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


#: Kind -> (expression, test of a match).
RULES: dict[str, tuple[re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (ASSIGN, lambda m: len(m[1]) >= LEAST_ASSIGN),
    "access": (ACCESS, lambda m: len(m[0]) >= LEAST_ACCESS),
    "github": (GITHUB, lambda m: has_base62_crc(m[0])),
    "npm": (NPM, lambda m: has_base62_crc(m[0])),
    "xkey": (XKEY, lambda m: has_base58_check(m[0])),
}


def keyword_automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        machine.add_word(word, (len(word), kind))
    machine.make_automaton()
    return machine


def lowered(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def hex_runs(text: str) -> list[Span]:
    """Maximal runs of at least 24 lower-case hex digits."""
    found: list[Span] = []
    sampled = text[STRIDE - 1 :: STRIDE]
    end = 0
    for hit in SAMPLED_HEX.finditer(sampled):
        for look in range(hit.start() * STRIDE + STRIDE - 1, hit.end() * STRIDE, STRIDE):
            if look < end:  # one sampled stretch can hold several runs
                continue
            start = look
            while start > end and text[start - 1] in _HEX_DIGITS:
                start -= 1
            end = HEX.match(text, look).end()
            if end - start >= LEAST_HEX:
                found.append((start, end, "hex"))
    return found


def scan_text(text: str, machine: ahocorasick.Automaton) -> list[Span]:
    """All spans ``(start, end, kind)`` by start, then kind as listed.

    Of each kind the leftmost matches that do not overlap count; those that fail their test
    are dropped afterwards, as if the expression had run over the whole text.
    """
    hits: dict[str, list[int]] = {}
    for last, (size, kind) in machine.iter(lowered(text)):
        hits.setdefault(kind, []).append(last - size + 1)
    found = hex_runs(text)
    for kind, starts in hits.items():
        expression, passes = RULES[kind]
        end = 0
        for start in sorted(starts):
            if start >= end and (match := expression.match(text, start)):
                end = match.end()
                if passes(match):
                    found.append((start, end, kind))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str | None, machine: ahocorasick.Automaton, mark: str) -> str | None:
    """``text`` with every span replaced by ``mark``; spans that overlap are replaced as one."""
    spans = scan_text(text, machine) if text else []
    if not spans:
        return text
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans``.

    A null text is scanned as an empty one. Null ids and repeated rows keep their row; an
    empty table gives none; further columns are ignored. Offsets are code points.
    """

    def make():
        machine = keyword_automaton()

        def work(batch: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for text in batch["text"]:
                spans = scan_text(text, machine) if text else []
                base = [s for s in spans if s[2] in BASE_KINDS]
                counts = [sum(s[2] == kind for s in base) for kind in BASE_KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy(dtype=object))
            return out

        return work

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"
    return map_rows(id_and_text(docs, id_col, text_col), make, schema)
