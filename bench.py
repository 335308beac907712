"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import os
import time

from gridlake import catalog
from gridlake.session import local_session

# openings, tiles, iteration, percentiles, survey
HEADLINE = (
    "V06_forest_stats", "V07_forest_loss_by_year", "L12_occurrence_classes", "K10_rain_summary", "K11_population_summary",
    "A07_composite", "W03_water_vote_area", "W06_despeckled_area", "W04_otsu_vote", "W07_occurrence", "W12_decade_changes",
    "F01_annual_extents", "R07_river_report", "H04_monthly_cycle", "C10_major_islands", "D04_damage_tiers", "Y02_pond_detection",
    "V04_seasonal_ndvi", "O03_crop_types", "L06_transitions", "N03_light_series", "J04_buildup_density", "T02_accessibility",
    "T05_market_access", "AQ05_pollution_hotspots", "K08_drought", "G05_groundwater", "S04_erosion_risk", "X10_texture_entropy",
    "X14_settlement_index", "X23_health_index", "B06_kiln_series", "AL6_alert_report", "M03_wealth_by_division",
    "M07_household_deprivation", "M09_district_demographics", "P31_focal_min_max", "P32_disc_kernel", "P34_connected_components",
    "P36_distance",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8)), "gridlake-bench")
    queries = catalog.build().queries
    queries["P05_map_collection"](spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm the JVM and the Python workers
    queries["P33_convolution"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(json.dumps({"metric": "total wall-clock of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "observation_rows": rows}))
    spark.stop()


if __name__ == "__main__":
    main()
