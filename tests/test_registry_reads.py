"""The place dimension needs the places alone."""

from waymesh.plans import catalog, shared

SF = "/root/testdata/sf0.001"


def test_places_are_counted_without_the_rest_of_the_network(spark):
    for name in ("net", "places"):
        shared.forget(name)
    assert sum(r.places for r in catalog.QUERIES["d9_migration_counts"](spark, SF).collect()) > 0
    assert not [key for key in shared._made if key[2] == "net"]
    known = {r.place for r in shared.places(spark, SF).collect()}
    assert known == {r.place for r in shared.net(spark, SF).degree.collect()}
