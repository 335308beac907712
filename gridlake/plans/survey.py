"""Household and census indicators. Weights are summed as integers where the source stores
integers, so results do not depend on row order."""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.model import DEPRIVED_CODES, DIVISION_CODES, RELIGIONS
from gridlake.sources.fixed_width import field, int_field

MICRO = 1_000_000


def division_name(code: Column) -> Column:
    pairs = [F.lit(v) for kv in DIVISION_CODES.items() for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), code.cast("int")), F.concat(F.lit("code_"), code.cast("string")))


def share(part: Column, whole: Column) -> Column:
    """Percentage of two weight sums; 0 for an empty whole."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)) * F.lit(100.0), F.lit(0.0))


def wealth_records(lines: DataFrame, layout: dict) -> DataFrame:
    """Typed wealth rows. Empty fields read as 0, a record with invalid text is dropped, and only
    rows with a division and a quintile stay. weight has 6 and score 5 implied decimals."""
    missing = [n for n in ("hv005", "hv024", "hv025", "hv270") if n not in layout]
    if missing:
        raise ValueError(f"layout lacks {missing}")
    out = {}
    for name, source in (("weight_micro", "hv005"), ("division_code", "hv024"), ("urban", "hv025"), ("quintile", "hv270"), ("score_raw", "hv271")):
        text = field(layout, source)
        out[name] = F.when(text.isNull(), F.lit(0).cast("bigint")).otherwise(text.try_cast("bigint"))
    rows = lines.select(*[e.alias(n) for n, e in out.items()]).dropna()
    return rows.filter((F.col("division_code") > 0) & (F.col("quintile") > 0)).withColumns(
        {"weight": F.col("weight_micro") / F.lit(1e6), "score": F.col("score_raw") / F.lit(1e5)})


def wealth_by_division(records: DataFrame, keys=()) -> DataFrame:
    """Households, weighted mean score and weighted quintile shares; weight <= 0 counts as 1."""
    w = F.when(F.col("weight_micro") > 0, F.col("weight_micro")).otherwise(F.lit(MICRO).cast("bigint"))
    df = records.withColumns({"division": division_name(F.col("division_code")), "_w": w})
    total = F.sum("_w")
    scores = F.sum((F.col("score_raw") * F.col("_w")).cast("decimal(38,0)")).cast("double")
    return df.groupBy(*keys, "division").agg(
        F.count(F.lit(1)).alias("households"), (scores / total / F.lit(1e5)).alias("mean_score"),
        *[share(F.sum(F.when(F.col("quintile") == i, F.col("_w")).otherwise(0)), total).alias(f"quintile_{i}_pct") for i in range(1, 6)])


def union_surveys(parts: dict[str, DataFrame]) -> DataFrame:
    """Surveys appended under a label; a missing one is given as None and skipped."""
    return reduce(DataFrame.unionByName, [df.withColumn("survey", F.lit(k)) for k, df in parts.items() if df is not None])


def _weighted(df: DataFrame, weight: Column, totals: dict[str, Column]) -> DataFrame:
    """Weight sums per division: each entry is a row condition."""
    aggs = [F.sum(F.when(cond, weight).otherwise(F.lit(0))).alias(n) for n, cond in totals.items()]
    return df.groupBy("division").agg(F.count(F.lit(1)).alias("records"), F.sum(weight).alias("_w"), *aggs)


def child_indicators(lines: DataFrame, layout: dict, division: str = "v024", weight: str = "v005", valid_weight: bool = False) -> DataFrame:
    """Weighted nutrition and illness percentages per division.

    Stunting, wasting and underweight divide by the total weight as published (by the weight with
    a valid measure when ``valid_weight``); diarrhoea, fever and BCG by the weight with a valid
    answer. A field missing from the layout gives 0."""
    v = lambda n, d: int_field(layout, n, d)
    df = lines.select(division_name(v(division, 0)).alias("division"), v(weight, MICRO).alias("w"), v("hw70", 9999).alias("hw70"),
                      v("hw71", 9999).alias("hw71"), v("hw72", 9999).alias("hw72"), v("h11", 9).alias("h11"),
                      v("h22", 9).alias("h22"), v("h2", 9).alias("h2"), v("h9", 9).alias("h9"))
    c = F.col
    ok = {"hw70": c("hw70").between(-600, 600), "hw71": c("hw71").between(-500, 500), "hw72": c("hw72").between(-600, 600)}
    totals = {"stunted": ok["hw70"] & (c("hw70") < -200), "wasted": ok["hw71"] & (c("hw71") < -200),
              "underweight": ok["hw72"] & (c("hw72") < -200), "ok70": ok["hw70"], "ok71": ok["hw71"], "ok72": ok["hw72"],
              "diarrhoea": c("h11").isin(1, 2), "d_all": c("h11").isin(0, 1, 2), "fever": c("h22") == 1, "f_all": c("h22").isin(0, 1),
              "bcg": c("h2").isin(1, 2, 3), "b_all": c("h2").isin(0, 1, 2, 3)}
    s = _weighted(df, c("w"), totals).filter(c("_w") != 0)
    base = (lambda k: c(k)) if valid_weight else (lambda k: c("_w"))
    return s.select("division", c("records").alias("children"), share(c("stunted"), base("ok70")).alias("stunted_pct"),
                    share(c("wasted"), base("ok71")).alias("wasted_pct"), share(c("underweight"), base("ok72")).alias("underweight_pct"),
                    share(c("diarrhoea"), c("d_all")).alias("diarrhoea_pct"), share(c("fever"), c("f_all")).alias("fever_pct"),
                    share(c("bcg"), c("b_all")).alias("bcg_pct"))


def women_indicators(lines: DataFrame, layout: dict, division: str = "v024", weight: str = "v005") -> DataFrame:
    v = lambda n, d: int_field(layout, n, d)
    df = lines.select(division_name(v(division, 0)).alias("division"), v(weight, MICRO).alias("w"), v("v313", 9 if "v313" in layout else 0).alias("v313"),
                      v("m14", 99).alias("m14"), v("m15", 99).alias("m15"), v("v201", 0).alias("v201"))
    c = F.col
    totals = {"any_method": (c("v313") > 0) & (c("v313") < 9), "modern": c("v313") == 3, "anc": (c("m14") >= 4) & (c("m14") < 98), "anc_all": c("m14") < 98,
              "facility": c("m15").between(20, 49), "births": c("m15") < 98}
    aggs = [F.sum(F.when(cond, c("w")).otherwise(F.lit(0))).alias(n) for n, cond in totals.items()]
    s = df.groupBy("division").agg(F.count(F.lit(1)).alias("women"), F.sum("w").alias("_w"), F.sum(c("v201") * c("w")).alias("_c"), *aggs).filter(c("_w") != 0)
    return s.select("division", "women", share(c("any_method"), c("_w")).alias("contraception_pct"), share(c("modern"), c("_w")).alias("modern_method_pct"),
                    share(c("anc"), c("anc_all")).alias("anc_4plus_pct"), share(c("facility"), c("births")).alias("facility_delivery_pct"),
                    (c("_c") / c("_w")).alias("mean_children"))


def household_deprivation(persons: DataFrame) -> DataFrame:
    """One row per (year, serial). Housing and ownership come from the first person; education and
    work look at members of 15 and over, schooling at 6 to 14 (no such child counts as deprived).

    All inputs are mergeable aggregates, so a large group never gathers in one task."""
    c, d = F.col, DEPRIVED_CODES
    adult, child = c("age") >= 15, c("age").between(6, 14)

    def any_of(group, column):
        return F.max(A.flag(group & ~c(column).isin(*d[column])))
    first = F.min_by(F.struct("geolev1", "geolev2", "urban", "hhwt", "wall", "roof", "toilet", "electric", "ownership"), c("pernum"))
    h = persons.groupBy("year", "serial").agg(
        first.alias("f"), F.count(F.lit(1)).alias("members"), any_of(adult, "lit").alias("lit"),
        F.greatest(F.lit(0), F.max(F.when(adult, c("edattain")))).alias("edu"), any_of(child, "school").alias("school"),
        any_of(adult, "empstat").alias("work"), any_of(adult, "labforce").alias("force"))

    def bad(column):
        return A.flag(c(f"f.{column}").isin(*d[column]))

    def none(column):
        return F.lit(1) - F.coalesce(c(column), F.lit(0))
    h = h.select(
        "year", "serial", c("f.geolev1").alias("geolev1"), c("f.geolev2").alias("geolev2"), c("f.urban").alias("urban"), c("f.hhwt").alias("hhwt"), "members",
        ((bad("wall") + bad("roof") + bad("toilet") + bad("electric")) / F.lit(4.0)).alias("housing"),
        ((none("lit") + A.flag(F.coalesce(c("edu"), F.lit(0)).isin(*d["edattain"])) + none("school")) / F.lit(3.0)).alias("education"),
        ((none("work") + none("force")) / F.lit(2.0)).alias("employment"), bad("ownership").cast("double").alias("assets"))
    return h.withColumn("mpi", (c("housing") + c("education") + c("employment") + c("assets")) / F.lit(4.0))


def district_deprivation(households: DataFrame) -> DataFrame:
    """Household-weighted means per (year, district); households without a district are dropped."""
    c, w = F.col, F.sum("hhwt")
    means = {"mpi": "mpi", "housing": "housing_dep", "education": "education_dep", "employment": "employment_dep", "assets": "assets_dep"}
    return (households.filter(c("geolev2").isNotNull() & (c("geolev2").cast("string") != "")).groupBy("year", "geolev2").agg(
        F.max("geolev1").alias("geolev1"), F.count(F.lit(1)).alias("households"), w.alias("total_weight"),
        *[(F.sum(c(k) * c("hhwt")) / F.nullif(w, F.lit(0))).alias(n) for k, n in means.items()],
        share(F.sum(F.when(c("urban") == 2, c("hhwt")).otherwise(0)), w).alias("urban_pct")).filter(c("total_weight") != 0))


def district_demographics(persons: DataFrame) -> DataFrame:
    """Person-weighted indicators per (year, district) in one conditional aggregate."""
    c, wt = F.col, F.col("perwt")
    adult, worker, pupil = c("age") >= 15, c("age").between(15, 64), c("age").between(6, 17)
    conds = {"male": c("sex") == 1, "female": c("sex") == 2, "young": c("age") < 15, "mid": worker, "old": c("age") >= 65,
             "lit": adult & (c("lit") == 2), "adults": adult, "in_school": pupil & (c("school") == 2), "pupils": pupil,
             "employed": worker & (c("empstat") == 1), "disabled": c("disabled") == 1, "urban": c("urban") == 2,
             "married": adult & (c("marst") == 2), "schooled": adult & c("yrschool").between(0, 30), "famous": c("famsize") > 0,
             "muslim": c("religion") == 4, "hindu": c("religion") == 2}
    sums = [F.sum(F.when(cond, wt).otherwise(F.lit(0))).alias(n) for n, cond in conds.items()]
    a = persons.filter(c("geolev2").isNotNull()).groupBy("year", "geolev2").agg(
        F.max("geolev1").alias("geolev1"), F.sum(wt).alias("population"), *sums,
        F.sum(F.when(conds["schooled"], c("yrschool") * wt).otherwise(0)).alias("_ys"),
        F.sum(F.when(conds["famous"], c("famsize") * wt).otherwise(0)).alias("_fs")).filter(c("population") != 0)

    def pct(part, whole="population"):
        return share(c(part), c(whole))

    def mean(total, weight):
        return F.coalesce(c(total) / F.nullif(c(weight), F.lit(0)), F.lit(0.0))
    return a.select(
        "year", "geolev1", "geolev2", "population", pct("male").alias("male_pct"), pct("female").alias("female_pct"), pct("young").alias("age_0_14_pct"),
        pct("mid").alias("age_15_64_pct"), pct("old").alias("age_65p_pct"), share(c("young") + c("old"), c("mid")).alias("dependency_ratio"),
        pct("lit", "adults").alias("literacy_rate"), pct("in_school", "pupils").alias("school_attendance_rate"), pct("employed", "mid").alias("employment_rate"),
        pct("disabled").alias("disability_pct"), pct("urban").alias("urban_pct"), pct("married", "adults").alias("married_pct"),
        mean("_ys", "schooled").alias("mean_yrschool"), mean("_fs", "famous").alias("mean_famsize"), pct("muslim").alias("muslim_pct"), pct("hindu").alias("hindu_pct"))


def age_pyramid(persons: DataFrame) -> DataFrame:
    """Weighted population per (year, district, 5-year bin); the last bin is 80+."""
    start = F.floor(F.col("age") / F.lit(5)).cast("int") * F.lit(5)
    label = F.when(start >= 80, F.lit("80+")).otherwise(F.concat(start.cast("string"), F.lit("-"), (start + 4).cast("string")))
    return (persons.filter(F.col("geolev2").isNotNull())
            .groupBy("year", "geolev2", F.least(start, F.lit(80)).alias("bin_start"), label.alias("age_bin"))
            .agg(F.sum("perwt").alias("population")).orderBy("year", "geolev2", "bin_start"))


def religion_distribution(persons: DataFrame) -> DataFrame:
    """Weighted population and percentage per (year, district, religion). The window runs over
    the few religions of a district."""
    names = F.create_map(*[F.lit(v) for kv in RELIGIONS.items() for v in kv])
    g = (persons.filter(F.col("geolev2").isNotNull())
         .groupBy("year", "geolev2", F.coalesce(F.element_at(names, F.col("religion").cast("int")), F.lit("unknown")).alias("religion"))
         .agg(F.sum("perwt").alias("population")))
    whole = F.sum("population").over(Window.partitionBy("year", "geolev2"))
    return g.withColumn("pct", share(F.col("population"), whole)).filter(F.col("population") > 0)
