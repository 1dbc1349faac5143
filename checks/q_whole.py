"""Queries once more over whole tables, where the fixture or the window of the first form leaves rows out."""

from __future__ import annotations

from checks import q_energy, q_offset, q_sources  # noqa: F401
from checks.fixtures import WHOLE
from checks.q_grid import JAN
from checks.registry import CTES, GIVEN, whole
from holdspan.options import ReadOptions

GRID = (
    "slot_energy common_span paired_slots paired_slots_join pairing_totals steps_as_samples paired_calendar size_range "
    "bounded_store capacity_sweep price_sizes marginal_payback best_size budget sensitivity_grid sizes_meeting_target "
    "payback_report"
).split()
RECORDER = (
    "statistics_samples counter_readings setting_history parse_value series_catalog series_kind value_count "
    "suggest_replacements"
).split()
OFFSET = "setting_intervals apply_offset offset_changes offset_direction offset_findings".split()
LOAD = "load_samples load_provenance load_refused write_tables".split()


def some(*names: str) -> dict[str, str]:
    return {name: WHOLE[name] for name in names}


# A reading without a value holds for no time, but ends the one before it.
for key in GRID:
    whole(key, some("fx_grid"), {"roles": CTES["roles"] + " and value is not null"})
for key in RECORDER:
    whole(key, some("fx_statistics", "fx_short", "fx_states"))
for key in OFFSET:
    whole(key, some("fx_settings"))

# Statistics and short-term rows keep their split, so that all three tables answer for some series;
# with all states, each event is in the table that answers for its series.
FROM, TO = f"{JAN + 86400}", f"{JAN + 20 * 86400}"
ALL_TIME = {"loaded_power": CTES["loaded_power"].replace(FROM, "0").replace(TO, f"{1 << 40}")}


def over_all_time(build):
    def run(fx):
        fx.options = ReadOptions()
        return build(fx)

    return run


for key in LOAD:
    whole(key, some("fx_states"), ALL_TIME, over_all_time(GIVEN[key][0]))
