"""Place-name expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The place groups in their display order, with label, display prefix and
# the pattern that recognises a typed prefix.
DEFAULT_GROUP = "other"
PLACE_GROUPS = [
    ("camp", "מחנה", "מ.", r"^מ(?:\.\s*|\s+)(?=\S)"),
    ("post", "מוצב", "מוצב", r"^מוצב\s+(?=\S)"),
    ("junction", "צומת", "צ.", r"^צ(?:\.\s*|\s+)(?=\S)"),
    ("interchange", "מחלף", "מחלף", r"^מחלף\s*(?=\S)"),
    ("firing_zone", "שטח אש", "ש.א", r"^ש[.\s]?א\s*(?=\S)"),
    ("road", "כביש", "כביש", r"^כביש\s+(?=\S)"),
    ("checkpoint", "מחסום", "מחסום", r"^מחסום\s+(?=\S)"),
    (DEFAULT_GROUP, "אחר", None, None),
]

# Characters read as the same, and characters that are only punctuation.
NIQQUD = r"[֑-ׇ]"
QUOTES = r"[\"“”„״´`]"
GERESH = r"['’‘׳]"
DASHES = r"[-–—־]"
PUNCTUATION = r"[\"'\-./()]"

# The tiers of a match.
EXACT, PREFIX, BARE_PREFIX, INSIDE, BARE_INSIDE, WORD_PREFIX, TYPO, TYPO_STEP = 1000, 900, 850, 750, 700, 650, 500, 20
TYPO_MIN_LENGTH, TYPO_SHARE = 3, 0.25
STRICT_BASE, STRICT_LEFTOVER, STRICT_EXACT = 900, 30, 5
FILTER_LIMIT = 8

_UNICODE = "(?U)"


def strip(text: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def groups_table(spark: SparkSession) -> DataFrame:
    """The vocabulary as a table ``(ord, key, label, prefix)``."""
    return spark.createDataFrame(
        [(i, k, label, prefix) for i, (k, label, prefix, _) in enumerate(PLACE_GROUPS)],
        "ord int, key string, label string, prefix string",
    )


def parsed_group(text: Column) -> Column:
    """The group a display name's prefix states, null if none."""
    trimmed = strip(F.coalesce(text, F.lit("")))
    found = None
    for key, _, _, pattern in PLACE_GROUPS:
        if pattern is None:
            continue
        hit = trimmed.rlike(_UNICODE + pattern)
        found = F.when(hit, key) if found is None else found.when(hit, key)
    return found


def parsed_base(text: Column) -> Column:
    """The name without its recognised prefix, null if there is none."""
    trimmed = strip(F.coalesce(text, F.lit("")))
    found = None
    for _, _, _, pattern in PLACE_GROUPS:
        if pattern is None:
            continue
        hit = trimmed.rlike(_UNICODE + pattern)
        rest = strip(F.regexp_replace(trimmed, _UNICODE + pattern, ""))
        found = F.when(hit, rest) if found is None else found.when(hit, rest)
    return found


def classify(text: Column) -> Column:
    """D3: the group of a name, the default one when no prefix is recognised."""
    return F.coalesce(parsed_group(text), F.lit(DEFAULT_GROUP))


def base_name(text: Column) -> Column:
    """The name a place is registered under."""
    return F.coalesce(parsed_base(text), strip(text))


def group_label(key: Column) -> Column:
    """D3: the group's label; an unknown key reads as the default group."""
    out = None
    for name, label, _, _ in PLACE_GROUPS:
        out = F.when(key == name, label) if out is None else out.when(key == name, label)
    return out.otherwise(dict((k, v) for k, v, _, _ in PLACE_GROUPS)[DEFAULT_GROUP])


def format_place(base: Column, key: Column) -> Column:
    """Display name; an unknown group shows the bare name."""
    out = None
    for name, _, prefix, _ in PLACE_GROUPS:
        if prefix is None:
            continue
        shown = F.concat(F.lit(prefix + " "), base)
        out = F.when(key == name, shown) if out is None else out.when(key == name, shown)
    return out.otherwise(base)


def keywords(name: Column) -> Column:
    """What a place is searched by: its name and its group's label."""
    return F.concat_ws(" ", name, group_label(classify(name)))


def normalize(text: Column) -> Column:
    """L1: lower case, one kind of quote and dash, single blanks."""
    out = F.regexp_replace(text, NIQQUD, "")
    out = F.regexp_replace(out, QUOTES, '"')
    out = F.regexp_replace(out, GERESH, "'")
    out = F.regexp_replace(out, DASHES, "-")
    out = F.regexp_replace(out, _UNICODE + r"\s+", " ")
    return F.lower(F.trim(out))


def strip_punct(text: Column) -> Column:
    """L2: without punctuation."""
    out = F.regexp_replace(text, PUNCTUATION, "")
    return F.trim(F.regexp_replace(out, _UNICODE + r"\s+", " "))


def words_of(text: Column) -> Column:
    """The words of a name without its recognised prefix."""
    return F.filter(F.split(strip_punct(normalize(base_name(F.coalesce(text, F.lit(""))))), " "), lambda w: w != "")


def typo_budget(length: Column) -> Column:
    """The edits a typed name of this length may hold (half rounds up)."""
    return F.greatest(F.lit(1), F.floor(length * F.lit(TYPO_SHARE) + 0.5).cast("int"))


# One row of the edit table per pattern letter; the first row is all 0 and the answer is
# the least of the last, so the pattern may sit anywhere in the text.
_DISTANCE = """
array_min(aggregate(
  sequence(1, length({p})), array_repeat(0, length({t}) + 1),
  (row, i) -> aggregate(
    sequence(1, length({t})), array(i),
    (out, j) -> array_append(out, least(
      row[j] + 1, out[j - 1] + 1,
      row[j - 1] + if(substring({p}, i, 1) = substring({t}, j, 1), 0, 1))))))"""


def substring_distance(pattern: str, text: str) -> Column:
    """L3: edits from column ``pattern`` to the nearest part of column ``text``."""
    spelled = _DISTANCE.format(p=pattern, t=text)
    return F.expr(
        f"case when length({pattern}) = 0 then 0 when length({text}) = 0 then length({pattern}) else {spelled} end"
    )


# A part of the text within d edits of the pattern is at most d letters shorter or longer,
# so only such parts are compared; null when none is near enough.
_WITHIN = """
array_min(flatten(transform(sequence(1, greatest(length({t}), 1)), s -> transform(
  sequence(length({p}) - {d}, length({p}) + {d}),
  n -> nullif(levenshtein({p}, substring({t}, s, n), {d}), -1)))))"""


def near_distance(pattern: str, text: str) -> Column:
    """L3 within the typo budget: the same distance where it is affordable, else null."""
    d = f"greatest(1, cast(floor(length({pattern}) * {TYPO_SHARE} + 0.5) as int))"
    return F.expr(
        f"if(length({pattern}) >= {TYPO_MIN_LENGTH}, {_WITHIN.format(p=pattern, t=text, d=d)}, null)"
    )


def match_score(q_norm: str, o_norm: str, q_strip: str, o_strip: str) -> Column:
    """L4: how well a name matches, from columns already normalised and stripped."""
    q, o, qs, os_ = F.col(q_norm), F.col(o_norm), F.col(q_strip), F.col(o_strip)
    at, bare_at = F.instr(o, q), F.instr(os_, qs)
    word = F.exists(F.split(os_, " "), lambda w: F.startswith(w, qs))
    far = near_distance(q_strip, o_strip)
    return (
        F.when(q == "", 0)
        .when(o == q, EXACT)
        .when(F.startswith(o, q), PREFIX - (F.length(o) - F.length(q)))
        .when(F.startswith(os_, qs), BARE_PREFIX - (F.length(os_) - F.length(qs)))
        .when(at > 0, INSIDE - (at - 1))
        .when(bare_at > 0, BARE_INSIDE - (bare_at - 1))
        .when(word, WORD_PREFIX)
        .otherwise(F.coalesce(TYPO - far * TYPO_STEP, F.lit(-1)))
        .cast("int")
    )


_STRICT = """
aggregate(q_words,
  named_struct('left', o_words, 'hits', 0, 'ok', true),
  (s, w) -> case
    when not s.ok then s
    when array_contains(s.left, w) then named_struct(
      'left', filter(s.left, (x, i) -> i <> array_position(s.left, w) - 1), 'hits', s.hits + 1, 'ok', true)
    when exists(s.left, x -> startswith(x, w)) then named_struct(
      'left', filter(s.left, (x, i) -> i <> array_position(transform(s.left, y -> startswith(y, w)), true) - 1),
      'hits', s.hits, 'ok', true)
    else named_struct('left', s.left, 'hits', s.hits, 'ok', false) end)"""


def strict_score() -> Column:
    """Every word of the query is a word of the name or begins one, each name word
    used once, whole words first. Reads ``q_words, o_words, q_strip, o_strip``."""
    walked = F.expr(_STRICT)
    return (
        F.when(F.size("q_words") == 0, 0)
        .when(F.size("o_words") == 0, -1)
        .when(F.col("q_strip") == F.col("o_strip"), EXACT)
        .when(walked["ok"], STRICT_BASE - F.size(walked["left"]) * STRICT_LEFTOVER + walked["hits"] * STRICT_EXACT)
        .otherwise(-1)
        .cast("int")
    )
