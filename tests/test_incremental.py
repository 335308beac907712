"""A state plus new scenes equals all scenes at once."""
import random
from datetime import date

from pyspark.sql import functions as F

from gridlake.operators import temporal
from gridlake.plans import incremental as inc

BANDS = ("red", "nir")


def scenes(seed, years, n=300):
    rng = random.Random(seed)
    return [(rng.randrange(12), y := rng.choice(years), date(y, rng.randrange(1, 13), 1), rng.choice([None, rng.randrange(50)]), rng.randrange(9), rng.choice([0, 0, 8])) for _ in range(n)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_batches_add_up(spark):
    make = lambda data: spark.createDataFrame(data, "cell_id long, yr int, t date, red int, nir int, qa int")
    parts = [scenes(1, (1999, 2000)), scenes(2, (2000, 2001)), scenes(3, (1999,), 5), []]
    state = inc.state_of(make(parts[0]), bands=BANDS)
    for part in parts[1:]:
        state = inc.merged(inc.state_of(make(part), bands=BANDS), state)
    everything = temporal.cloud_free(make([r for p in parts for r in p]))
    for method in ("median", "mean", "min", "max"):
        assert rows(inc.composites(state, bands=BANDS, method=method)) == rows(temporal.composite(everything, ["cell_id", "yr"], method, BANDS)), method


def test_store_rewrites_only_the_years_touched(spark, tmp_path):
    make = lambda data: spark.createDataFrame(data, "cell_id long, yr int, t date, red int, nir int, qa int")
    first, second = scenes(4, (1999, 2000)), scenes(5, (2000, 2001))
    base, month = str(tmp_path / "base"), str(tmp_path / "month")
    inc.state_of(make(first), bands=BANDS).write.partitionBy("yr").parquet(base)
    assert inc.update_store(spark, base, make(second), month, bands=BANDS) == [2000, 2001]
    assert inc.update_store(spark, base, make([]), str(tmp_path / "none"), bands=BANDS) == []
    now = spark.read.parquet(month).select("cell_id", "yr", "band", "value", "n")
    whole = inc.state_of(make(first + second), bands=BANDS).filter("yr >= 2000")
    assert rows(now) == rows(whole)
    before = inc.composites(spark.read.parquet(base), bands=BANDS)
    fell = inc.flagged_changes(before, inc.composites(now, bands=BANDS), F.col("nir"), 0.5)
    both = {(r.cell_id, r.yr): r.nir for r in before.collect()}
    want = {(r.cell_id, r.yr) for r in inc.composites(whole, bands=BANDS).collect() if (r.cell_id, r.yr) in both and both[r.cell_id, r.yr] - r.nir > 0.5}
    assert {(r.cell_id, r.yr) for r in fell.collect()} == want
