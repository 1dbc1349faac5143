"""The whole forms of queries read every event."""

from checks import all_queries
from checks.fixtures import WHOLE, Fixtures

SF = "/root/testdata/sf0.001"
QUERIES, _ = all_queries()


def test_whole_fixtures_hold_every_event(spark):
    fx = Fixtures(spark, SF, WHOLE)
    events = fx.table("events")
    n, errors = events.count(), events.where("event_type = 'error'").count()
    assert fx.fx_states.count() == fx.fx_settings.count() == n
    assert fx.fx_grid.where("value is null and role = 'import'").count() == errors > 0
    assert fx.fx_grid.select("row_id").distinct().count() == n
    ids = events.selectExpr("user_id % 25 as id").distinct().count()
    for name in ("fx_statistics", "fx_short"):
        assert getattr(fx, name).select("metadata_id").distinct().count() == ids


def test_an_outage_reaches_the_payback_chain(spark):
    held = [QUERIES[key](spark, SF).selectExpr("sum(seconds)").first()[0] for key in ("slot_energy", "slot_energy_whole")]
    assert held[1] < held[0]


def test_load_is_not_cut_to_a_window(spark):
    ends = [QUERIES[key](spark, SF).selectExpr("max(end_ts) - min(start_ts)").first()[0] for key in ("load_samples", "load_samples_whole")]
    assert ends[0] <= 19 * 86400 < ends[1]
