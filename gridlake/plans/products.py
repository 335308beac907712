"""Batch products: each returns the tables of one domain report as {name: DataFrame}.

Inputs that several tables of a report share (rice masks, monthly NDVI, the transport raster, yearly pollutants)
are stored once, which runs Spark jobs as the report is built; the rest runs as a table is written."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions import algebra as A
from gridlake.model import Grid
from gridlake.model import POLLUTANT_START
from gridlake.session import stored
from gridlake.plans import (air, climate, coast, composite, crops, cyclones, landcover, lights, ponds, settlement, soil, transport,
                            vegetation)


def raster_summary(df: DataFrame, value: str, keys=("yr",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))


def accretion(wide: DataFrame, years, zone_cells: DataFrame, cells: DataFrame, min_area_m2: int = 500_000) -> dict[str, DataFrame]:
    """New land per decade pair, islands and vulnerability of the last pair, total first to last."""
    last = coast.new_land(wide, years[-2], years[-1]).join(cells.select("cell_id", "occurrence"), "cell_id")
    total = coast.new_land(wide, years[0], years[-1]).agg(A.km2(F.col("new_land"), F.col("area_m2")).alias("new_land_km2"))
    return {"series": coast.accretion_series(wide, years, zone_cells), "islands": coast.major_islands(last, min_area_m2),
            "vulnerability": coast.vulnerability(last), "total": total}


def coastal(cells: DataFrame, population: DataFrame, obs: DataFrame, vegetation_obs: DataFrame, event_cells: DataFrame, area: Column,
            shoreline_years, mangrove_years, loss_span) -> dict[str, DataFrame]:
    return {"low_coast": coast.low_coast_areas(cells), "population": coast.low_coast_population(cells, population, 5, ["epoch"]),
            "shoreline": coast.shoreline_change(coast.dry_water_years(obs, shoreline_years), shoreline_years, area),
            "mangrove": coast.mangrove_areas(cells, mangrove_years), "health": coast.mangrove_health(vegetation_obs, cells),
            "loss": coast.mangrove_loss(cells, *loss_span), "storms": cyclones.ndvi_drop(vegetation_obs, event_cells)}


def pond_report(found: DataFrame, cells: DataFrame, zone_cells: DataFrame, key: str, years_since_2000: int) -> dict[str, DataFrame]:
    """Pond area and conversion for every (zone, year): zones are a grouping key."""
    zoned = found.join(zone_cells.select(key, "cell_id"), "cell_id")
    wooded = (F.col("treecover") > 30) | ((F.col("lossyear") > 0) & (F.col("lossyear") <= years_since_2000))
    was = cells.filter(wooded & (ponds.coastal_low() == 1)).select("cell_id")
    km2 = (F.sum("area_m2") / F.lit(1e6))
    return {"area": zoned.groupBy(key, "yr").agg(km2.alias("pond_km2")),
            "conversion": zoned.join(was, "cell_id", "left_semi").groupBy(key, "yr").agg(km2.alias("conversion_km2"))}


def crop_report(obs: DataFrame, classes: DataFrame, vegetation_obs: DataFrame, cells: DataFrame, area: Column, profile_years, baseline) -> dict[str, DataFrame]:
    rice = stored(crops.rice_masks(obs), "rice")
    types = crops.crop_types(landcover.yearly_mode(classes), rice)
    monthly = stored(crops.monthly_means(vegetation_obs), "monthly")
    intensity = crops.intensity_of(monthly, cells)
    return {"rice": crops.rice_areas(rice, area), "types": crops.crop_areas(types, area),
            "profile": crops.profile_of(monthly, cells, profile_years), "yield": crops.yield_proxy(vegetation_obs),
            "stress": raster_summary(crops.crop_stress(vegetation_obs, *baseline), "crop_stress"),
            "intensity": intensity.groupBy("yr", "intensity").agg(F.count(F.lit(1)).alias("cells"))}


def land_report(classes: DataFrame, cells: DataFrame, area: Column, pairs) -> dict[str, DataFrame]:
    modes = landcover.yearly_mode(classes)
    out = {"areas": landcover.area_series(modes, area), "proportions": landcover.proportion_series(classes),
           "static": cells.groupBy("worldcover").agg((F.sum("area_m2") / F.lit(1e6)).alias("area_km2"))}
    for a, b in pairs:
        out[f"transitions_{a}_{b}"] = landcover.transition_areas(landcover.transitions(classes, a, b), area)
    return out


def light_report(annual: DataFrame, zone_cells: DataFrame, key: str, area: Column, pairs, last_a: int) -> dict[str, DataFrame]:
    out = {"series": lights.stats(annual, last_a=last_a), "electrified": lights.lit_area(annual, area, last_a),
           "cities": lights.by_zone(annual, zone_cells, key, last_a)}
    for a, b in pairs:
        out[f"change_{a}_{b}"] = raster_summary(lights.change(annual, a, b, last_a), "diff", ())
    return out


def infrastructure_report(modes: DataFrame, built: DataFrame, raster: DataFrame, zone_cells: DataFrame, key: str, grid: Grid, pair, radius: int,
                          hotspot_radius: int, connect: dict) -> dict[str, DataFrame]:
    area = grid.area()
    between = settlement.construction_between(modes, *pair)
    return {"between": settlement.construction_areas(between, area, ()), "series": settlement.construction_areas(settlement.construction(modes), area),
            "zones": settlement.growth_by_zone(built, zone_cells, key),
            "density": raster_summary(settlement.buildup_density(built, radius), "density_km2", ("epoch",)),
            "connectivity": raster_summary(transport.connectivity(raster, F.col("yr"), ["yr"], **connect), "connectivity"),
            "hotspots": settlement.hotspots(grid.attach(between), hotspot_radius).groupBy("threshold").agg(F.sum("hotspot").alias("hotspot_cells"))}


def transport_report(raster: DataFrame, built: DataFrame, zone_cells: DataFrame, area: Column, bright: float = 5.0) -> dict[str, DataFrame]:
    """Every year of the raster; its rows are keyed by yr."""
    raster = stored(raster, "raster")
    index = transport.underserved(raster)
    place = ["cell_id", "x", "y", "yr", "light"]
    market = stored(transport.market_access(raster.select(*place), ["yr"], bright=bright).select("yr", "market_access", "light_gradient"), "market")
    return {"settlement": transport.settlement_areas(built, area), "accessibility": raster_summary(transport.accessibility(raster.select(*place, "population", "smod"), ["yr"]), "accessibility"),
            "underserved": transport.underserved_population(index, keys=["yr"]), "gap": transport.gap_by_zone(index, zone_cells, ["division", "yr"]),
            "market": raster_summary(market, "market_access"), "gradient": raster_summary(market, "light_gradient")}


def air_report(df: DataFrame, qa: Column, zone_cells: DataFrame, key: str, span, pollutants=tuple(air.COLUMNS),
               reliable: str | None = POLLUTANT_START) -> dict[str, DataFrame]:
    """Series per pollutant, seasons, cities, hotspots and the yearly stack of one span."""
    yearly = stored(air.yearly(df, qa, reliable=reliable), "air")
    out = {f"series_{p}": t for p, t in air.stats_of(yearly, pollutants).items()}
    out |= {f"seasons_{p}": t for p, t in air.seasonal_of(df, qa, pollutants[:2]).items()}
    zoned = yearly.join(zone_cells.select(key, "cell_id"), "cell_id")
    out |= {f"cities_{p}": t for p, t in air.stats_of(zoned, pollutants[:2], (key, "yr")).items()}
    out["hotspots"] = air.hotspots(yearly.select("cell_id", "yr", "no2"), "no2").groupBy("yr", "threshold").agg(F.sum("hotspot").alias("hotspot_cells"))
    stack = air.stack(df, qa, *span, reliable, ("cell_id", "yr"))
    out["stack"] = stack.agg(*[F.avg(p).alias(p) for p in pollutants])
    return out


def climate_report(df: DataFrame, cells: DataFrame, centres: DataFrame, ring: tuple, baseline: tuple) -> dict[str, DataFrame]:
    urban, inner, outer = ring
    first, last, lst_first = baseline
    return {"rain": climate.rain_series(df), "temperature": climate.lst_series(df), "monsoon": climate.monsoon_rain(df),
            "heat_island": climate.heat_island(climate.annual_lst(df), cells, centres, urban, inner, outer),
            "drought": raster_summary(climate.drought(df, first, last, lst_first), "drought")}


def static_report(cells: DataFrame, population: DataFrame, rain: DataFrame | None, area: Column) -> dict[str, DataFrame]:
    """Static-layer statistics; an input given as None skips its part."""
    out = {"forest": vegetation.forest_stats(cells), "loss_by_year": vegetation.forest_loss_by_year(cells), "water": landcover.occurrence_classes(cells)}
    if rain is not None:
        out["rain"] = climate.rain_summary(rain)
    if population is not None:
        out["population"] = climate.population_summary(population, area, ["epoch"])
    return out


def soil_report(properties: DataFrame, factors: DataFrame, salinity: DataFrame, cells: DataFrame) -> dict[str, DataFrame]:
    risk = salinity.join(cells.select("cell_id", "elevation"), "cell_id").withColumn("salinity_risk", soil.salinity_risk())
    return {"properties": soil.property_stats(properties), "erosion": raster_summary(soil.erosion_risk(factors), "erosion_risk"),
            "salinity": raster_summary(salinity, "salinity_proxy"), "salinity_risk": raster_summary(risk, "salinity_risk"),
            "suitability": raster_summary(soil.suitability(factors), "suitability")}


def deprivation_report(index: DataFrame, zone_cells: DataFrame, pair, uncertainty: float = 25.0) -> dict[str, DataFrame]:
    """Zone statistics, change, and the yearly mean and median with the constant uncertainty in percent."""
    series = composite.mean_median(index, "deprivation", ("yr",))
    return {"divisions": composite.stats_by_zone(index, "deprivation", zone_cells, "division"),
            "change": raster_summary(composite.index_change(index, "deprivation", *pair), "change", ()),
            "series": series.withColumn("uncertainty_pct", F.lit(uncertainty))}
