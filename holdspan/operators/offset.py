"""Corrections recorded as a setting: which setting belongs to a sensor, which way it works, undoing it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from holdspan.operators.chunks import CHUNK, chunk_of, with_previous

# Words of an offset setting (inside a word) and of a measurement (whole words).
OFFSET_WORDS = ("offset", "calibration", "kalibrierung", "versatz", "korrektur")
MEASURE_WORDS = ("temperature", "temperatur", "local", "lokale", "lokaler", "current")
# The least change judged, how old the reading before it may be, how long after it
# a move is looked for, and the slack around its instant; degrees and seconds.
MIN_JUDGED_CHANGE = 0.5
BEFORE_WINDOW = 1_800
AFTER_WINDOW = 300
GRACE = 60

SENSOR = ("site_id", "sensor")
SETTING = ("site_id", "setting")
ALWAYS = -(2**62)
FOREVER = 2**62


def _object_id(entity: Column) -> Column:
    return F.regexp_replace(entity, r"^[^.]*\.", "")


def _device_of_sensor(sensor: Column) -> Column:
    words = "|".join(MEASURE_WORDS)
    return F.regexp_replace(_object_id(sensor), f"((^|_)({words}))+$", "")


def _devices_of_setting(setting: Column) -> Column:
    """The device names that, taken off the front, leave only measure and offset words."""
    words = F.split(_object_id(setting), "_")

    def is_offset(word: Column) -> Column:
        return word.rlike("|".join(OFFSET_WORDS))

    def leaves_setting(i: Column) -> Column:
        rest = F.slice(words, i + 1, F.size(words) - i)
        plain = F.forall(rest, lambda w: is_offset(w) | w.isin(*MEASURE_WORDS))
        return plain & F.exists(rest, is_offset)

    cuts = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        F.filter(cuts, leaves_setting), lambda i: F.array_join(F.slice(words, 1, i), "_")
    )


def match_settings(sensors: DataFrame, settings: DataFrame) -> DataFrame:
    """Sensor and setting of one device: an equi-join on the device each name implies."""
    own = sensors.withColumn("_device", _device_of_sensor(F.col("sensor"))).filter("_device <> ''")
    theirs = settings.withColumn("_device", F.explode(_devices_of_setting(F.col("setting"))))
    return own.join(theirs, ["site_id", "_device"]).select("site_id", "sensor", "setting")


def setting_intervals(history: DataFrame, keys: Sequence[str] = SETTING) -> DataFrame:
    """A setting's value over ``[from_ts, to_ts)``; its first value also holds before its time."""
    order = ["ts", "row_id"]
    seen = with_previous(history, keys, order, ["value"], "_before")
    # Rows between two changes repeat a value, so the row before a change holds the value before it.
    before = F.col("_before.value")
    steps = seen.filter(F.col("_before").isNull() | (before != F.col("value")))
    both = with_previous(steps, keys, order, ["ts"], "_next", backwards=True)
    return both.select(
        *keys,
        F.when(F.col("_before").isNull(), F.lit(ALWAYS)).otherwise(F.col("ts")).cast("bigint").alias("from_ts"),
        F.coalesce(F.col("_next.ts"), F.lit(FOREVER)).cast("bigint").alias("to_ts"),
        F.col("ts").alias("changed_ts"),
        before.alias("before"),
        F.col("value").alias("degrees"),
    )


def apply_offset(
    samples: DataFrame,
    intervals: DataFrame,
    sign: Column | int = 1,
    scale: float = 1.0,
    keys: Sequence[str] = SENSOR,
    seconds: int = CHUNK,
) -> DataFrame:
    """Samples with ``sign * scale * degrees`` taken out, cut where the setting changes.

    Starts of samples and of settings are one stream of events. Each event begins at most one piece: of
    its own sample under the setting in force, or of the sample that is still open when a setting starts.
    Both are carried from event to event inside a chunk and by one row a chunk beyond it, so a setting
    costs one row however long it holds, and a busy sensor spreads over its days.

    Neither the samples of a sensor nor its settings overlap. Parts of a sample at which no setting is in
    force are left out; samples of a sensor without any recorded setting are passed on as they are, also
    those with a null key. ``sign`` may be a column of either side.
    """
    keys = list(keys)
    plain = not isinstance(sign, Column)
    own = ["start_ts", "end_ts", "value"] if plain else [c for c in samples.columns if c not in keys]
    held = ["from_ts", "to_ts", "degrees"] if plain else [c for c in intervals.columns if c not in keys]
    # As a struct the key is never null itself, so the join below does not filter one of the branches.
    key = F.struct(*keys).alias("_key")
    begun = samples.filter("end_ts > start_ts").select(
        key, F.col("start_ts").alias("_at"), F.lit(1).alias("_side"), F.struct(*own).alias("_sample")
    )
    changes = intervals.filter("degrees is not null and to_ts > from_ts").select(
        key, F.col("from_ts").alias("_at"), F.lit(0).alias("_side"), F.struct(*held).alias("_setting")
    )
    events = begun.unionByName(changes, allowMissingColumns=True)
    # Both branches below read all columns of this one shuffle, none filtered, so that it is done once.
    chunk = F.coalesce(chunk_of(F.col("_at"), seconds), F.lit(0))
    events = events.withColumn("_chunk", chunk).repartition("_key", "_chunk")

    def latest(state: str) -> Column:
        return F.max_by(state, F.when(F.col(state).isNotNull(), F.struct("_at", "_side")))

    ends = events.groupBy("_key", "_chunk").agg(latest("_sample").alias("_sample"), latest("_setting").alias("_setting"))
    of = Window.partitionBy("_key")
    before = of.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "_key",
        "_chunk",
        F.last("_sample", True).over(before).alias("_open"),
        F.last("_setting", True).over(before).alias("_force"),
        F.max(F.col("_setting").isNotNull()).over(of).alias("_known"),
    )
    here = Window.partitionBy("_key", "_chunk").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    local = events.withColumns({f"_near{c}": F.last(c, True).over(here) for c in ("_sample", "_setting")})
    whole = reduce(and_, [F.col(f"_key.{k}").isNotNull() for k in keys])
    met = local.join(carried, ["_key", "_chunk"]).select(
        *[F.col(f"_key.{k}").alias(k) for k in keys],
        "_at",
        (F.col("_known") & whole).alias("_known"),
        (F.col("_side") == 0).alias("_changes"),
        F.coalesce("_sample", "_near_sample", "_open").alias("_sample"),
        F.coalesce("_near_setting", "_force").alias("_setting"),
    )
    factor = F.lit(float(sign)) if plain else sign
    flat = met.select(*keys, "_at", "_known", "_changes", "_sample.*", "_setting.*")
    stop = F.when(F.col("_known"), F.least("end_ts", F.when(F.col("degrees").isNotNull(), F.col("to_ts")).otherwise(F.col("_at"))))
    taken = F.when(F.col("_known"), factor * F.lit(scale) * F.col("degrees")).otherwise(F.lit(0.0))
    return (
        flat.withColumn("_stop", stop.otherwise(F.col("end_ts")))
        .filter("_stop > _at and end_ts > _at and (_known or not _changes)")
        .select(*keys, F.col("_at").alias("start_ts"), F.col("_stop").alias("end_ts"), (F.col("value") - taken).alias("value"))
    )


def judged_changes(
    intervals: DataFrame, readings: DataFrame, keys: Sequence[str] = SENSOR
) -> DataFrame:
    """Each sizeable change of a setting with how the readings moved: added, subtracted, unmoved.

    The reading before it must be recent; after it, the largest move inside the window counts.
    ``readings``: keys, ts, row_id, value.

    The largest move is towards the highest or the lowest reading of the window, so no pairs are formed.
    A window is as long as a block: it is the rest of the block it starts in and the start of the next one,
    and both are running extremes. Changes and readings, one row a second, travel as one stream; a reading
    near the end of a chunk is also sent to the next one, where it can only be the reading before a change.
    """
    step = F.col("degrees") - F.col("before")
    changes = (
        intervals.filter(F.abs(step) >= MIN_JUDGED_CHANGE)
        .select(*keys, "changed_ts", step.alias("step"))
        .dropna(subset=list(keys))
        .distinct()
    )
    first, last = F.col("changed_ts") - GRACE, F.col("changed_ts") + AFTER_WINDOW
    # At one instant the start of a window comes before the readings, its end after them.
    ends = F.array(F.struct(first.alias("_at"), F.lit(0).alias("_side")), F.struct(last.alias("_at"), F.lit(2).alias("_side")))
    asked = changes.select(*keys, "step", F.inline(ends)).withColumn("_chunk", chunk_of(F.col("_at")))
    seconds = readings.filter("ts is not null").groupBy(*keys, F.col("ts").alias("_at")).agg(
        F.max(F.struct("row_id", "value")).alias("_latest"),
        F.max(F.struct("value", "row_id")).alias("_high"),
        F.max(F.struct((-F.col("value")).alias("value"), "row_id")).alias("_low"),
    )
    chunk = chunk_of(F.col("_at"))
    homes = F.when(F.col("_at") + BEFORE_WINDOW >= chunk + CHUNK, F.array(chunk, chunk + CHUNK)).otherwise(F.array(chunk))
    # Plain columns, and results only where they are asked for, keep the rows of both sorts small.
    seen = seconds.select(
        *keys,
        "_at",
        F.lit(1).alias("_side"),
        F.explode(homes).alias("_chunk"),
        F.col("_latest.value").alias("_latest"),
        *[F.col(f"_{c}.{f}").alias(f"_{c}_{f}") for c in ("high", "low") for f in ("value", "row_id")],
    )
    stream = asked.unionByName(seen, allowMissingColumns=True).withColumn("_block", chunk_of(F.col("_at"), GRACE + AFTER_WINDOW))

    here, block = Window.partitionBy(*keys, "_chunk"), Window.partitionBy(*keys, "_chunk", "_block")
    so_far = (Window.unboundedPreceding, 0)
    forth = block.orderBy("_at", "_side").rowsBetween(*so_far)
    back = block.orderBy(F.desc("_at"), F.desc("_side")).rowsBetween(*so_far)
    reading = F.col("_side") == 1

    def furthest(of: str, way: WindowSpec) -> Column:
        row = F.struct(F.col(f"_{of}_value").alias("value"), F.col("_at").alias("ts"), F.col(f"_{of}_row_id").alias("row_id"))
        return F.max(F.when(reading, row)).over(way)

    last_reading = F.last(F.when(reading, F.struct(F.col("_at").alias("ts"), F.col("_latest").alias("value"))), True)
    before = last_reading.over(here.orderBy("_block", "_at", "_side").rowsBetween(*so_far))
    starts, stops = F.col("_side") == 0, F.col("_side") == 2
    until = stream.withColumn("_reading", F.when(starts, before)).withColumns(
        {f"_to_{c}": F.when(stops, furthest(c, forth)) for c in ("high", "low")}
    )
    known = until.withColumns({f"_from_{c}": F.when(starts, furthest(c, back)) for c in ("high", "low")}).filter(~reading)
    changed = F.col("_at") + F.when(starts, F.lit(GRACE)).otherwise(F.lit(-AFTER_WINDOW))
    moved = (
        known.groupBy(*keys, changed.alias("changed_ts"), "step")
        .agg(
            F.max("_reading").alias("_reading"),
            *[F.max(F.coalesce(f"_from_{c}", f"_to_{c}")).alias(f"_{c}") for c in ("high", "low")],
        )
        .filter(F.col("changed_ts") - F.col("_reading.ts") <= BEFORE_WINDOW + GRACE)
        .filter("_high is not null")
    )

    def move(value: Column, of: str) -> Column:
        delta = value - F.col("_reading.value")
        return F.struct(F.abs(delta).alias("size"), F.col(f"{of}.ts").alias("ts"), F.col(f"{of}.row_id").alias("row_id"), delta.alias("moved"))

    most = F.greatest(move(F.col("_high.value"), "_high"), move(-F.col("_low.value"), "_low"))
    moved = moved.withColumn("_most", most)
    by = F.col("_most.moved")
    verdict = (
        F.when(F.abs(by) < F.abs(F.col("step")) / 2, "unmoved")
        .when(F.signum(by) == F.signum("step"), "added")
        .otherwise("subtracted")
    )
    return moved.select(*keys, "changed_ts", "step", by.alias("moved"), verdict.alias("verdict"))


def offset_direction(judged: DataFrame, sensors: DataFrame, keys: Sequence[str] = SENSOR) -> DataFrame:
    """Per sensor, whether its setting is added or subtracted; all but subtracted is taken as added."""
    counts = judged.groupBy(*keys).agg(
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("added", "subtracted", "unmoved")]
    )
    known = sensors.select(*keys).distinct().join(counts, list(keys), "left").fillna(0)
    added, subtracted = F.col("added"), F.col("subtracted")
    check = (
        F.when((added == 0) & (subtracted == 0), F.when(F.col("unmoved") > 0, "unmoved").otherwise("untested"))
        .when(subtracted == 0, "added")
        .when(added == 0, "subtracted")
        .otherwise("mixed")
    )
    return known.withColumn("check", check).withColumn(
        "sign", F.when(F.col("check") == "subtracted", -1).otherwise(1)
    )


def offset_findings(
    sensors: DataFrame,
    matches: DataFrame,
    intervals: DataFrame,
    directions: DataFrame,
    samples: DataFrame,
) -> DataFrame:
    """Per sensor: none, ambiguous, unrecorded or corrected, and from when the setting was assumed.

    ``intervals`` are per ``(site_id, setting)``, ``directions`` and ``samples`` per sensor.
    """
    found = matches.groupBy(*SENSOR).agg(
        F.count(F.lit(1)).alias("matches"), F.min("setting").alias("setting")
    )
    recorded = intervals.groupBy(*SETTING).agg(F.min("changed_ts").alias("_first"))
    starts = samples.groupBy(*SENSOR).agg(F.min("start_ts").alias("_start"))
    rows = (
        sensors.select(*SENSOR)
        .distinct()
        .join(found, list(SENSOR), "left")
        .join(recorded, list(SETTING), "left")
        .join(directions.select(*SENSOR, "check"), list(SENSOR), "left")
        .join(starts, list(SENSOR), "left")
    )
    finding = (
        F.when(F.col("matches").isNull(), "none")
        .when(F.col("matches") > 1, "ambiguous")
        .when(F.col("_first").isNull(), "unrecorded")
        .otherwise("corrected")
    )
    corrected = F.col("finding") == "corrected"
    return rows.withColumn("finding", finding).select(
        *SENSOR,
        "finding",
        F.when(F.col("matches") == 1, F.col("setting")).alias("setting"),
        F.when(corrected, F.coalesce("check", F.lit("untested"))).alias("check"),
        F.when(corrected & (F.col("_start") < F.col("_first")), F.col("_first")).alias("assumed_before"),
    )


def take_out_offsets(
    samples: DataFrame,
    sensors: DataFrame,
    names: DataFrame,
    history: DataFrame,
    readings: DataFrame,
    settle: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[DataFrame, DataFrame]:
    """Samples as the devices measured them, and what was found for each sensor.

    ``sensors``: site_id, sensor and ``scale``, the factor from a setting's degrees to those of the samples;
    ``names``: every setting there is, also one without a history; ``history`` of the settings and
    ``readings`` of the sensors as recorded. Only a sensor with exactly one setting is corrected, in the
    direction its own readings show. Settled, each sensor's setting is worked out once for both results.
    """
    matches = match_settings(sensors, names)
    single = matches.groupBy(*SENSOR).agg(F.count(F.lit(1)).alias("_n"), F.min("setting").alias("setting"))
    spans = settle(setting_intervals(history))
    own = spans.join(single.filter("_n = 1").select(*SENSOR, "setting"), list(SETTING)).drop("setting")
    directions = settle(offset_direction(judged_changes(own, readings), sensors))
    by = directions.join(sensors, list(SENSOR)).select(*SENSOR, (F.col("sign") * F.col("scale")).alias("_by"))
    corrected = apply_offset(samples, own.join(by, list(SENSOR)), sign=F.col("_by"))
    return corrected, offset_findings(sensors, matches, spans, directions, samples)
