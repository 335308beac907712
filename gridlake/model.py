"""Sensors, calendars, class tables and named study zones.

Everything in this module is a constant that results depend on. Zones are
small dimension tables; ``zone_table`` turns one of them into a DataFrame.
"""
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: analysis calendar --------------------------------------
ANALYSIS_START_YEAR = 1985
ANALYSIS_END_YEAR = 2025
DECADE_YEARS = (1985, 1995, 2005, 2015, 2025)
EXTREME_FLOOD_YEARS = (1987, 1988, 1998, 2004, 2007, 2017, 2020, 2022)


@dataclass(frozen=True)
class Season:
    """Half-open date window of season-year y: [y+start_off-start, y+end_off-end)."""
    name: str
    start_off: int
    start: tuple
    end_off: int
    end: tuple

    def bounds(self, year: Column) -> tuple:
        return (F.make_date(year + F.lit(self.start_off), F.lit(self.start[0]), F.lit(self.start[1])),
                F.make_date(year + F.lit(self.end_off), F.lit(self.end[0]), F.lit(self.end[1])))


# --- Fixed values: named season windows (ends are exclusive) ---------------
DRY = Season("dry", -1, (12, 1), 0, (2, 28))
MONSOON = Season("monsoon", 0, (7, 1), 0, (9, 30))
DRY_MONSOON = (DRY, MONSOON)
LOW_WATER = Season("low_water", 0, (11, 1), 1, (3, 1))
NDVI_SEASONS = (Season("pre_monsoon", 0, (3, 1), 0, (5, 31)), Season("monsoon", 0, (6, 1), 0, (9, 30)),
                Season("post_monsoon", 0, (10, 1), 0, (11, 30)), Season("winter", 0, (12, 1), 1, (3, 1)))
AIR_SEASONS = (Season("winter", 0, (1, 1), 0, (3, 1)), Season("pre_monsoon", 0, (3, 1), 0, (5, 31)),
               Season("monsoon", 0, (6, 1), 0, (9, 30)), Season("post_monsoon", 0, (10, 1), 0, (12, 31)))
CALENDAR_YEAR = Season("year", 0, (1, 1), 0, (12, 31))
RAIN_MONSOON = Season("monsoon", 0, (6, 1), 0, (9, 30))
RICE_PHASES = {
    "aman": (Season("flood", 0, (7, 1), 0, (8, 31)), Season("peak", 0, (9, 1), 0, (10, 31))),
    "boro": (Season("flood", 0, (1, 1), 0, (2, 28)), Season("peak", 0, (3, 1), 0, (4, 15))),
    "aus": (Season("flood", 0, (4, 1), 0, (5, 31)), Season("peak", 0, (6, 1), 0, (7, 15))),
}
YIELD_WINDOWS = {
    "aman": Season("aman", 0, (8, 1), 0, (11, 30)), "boro": Season("boro", 0, (2, 1), 0, (5, 15)),
    "aus": Season("aus", 0, (4, 1), 0, (8, 31)),
}
CROP_STRESS = Season("stress", 0, (8, 1), 0, (10, 31))
SOLAR_SEASONS = (Season("dry", 0, (11, 1), 1, (3, 1)), Season("monsoon", 0, (6, 1), 0, (10, 1)))
HEAT_SEASON = Season("heat", 0, (3, 1), 0, (10, 31))
POLLUTION_SEASON = Season("pollution", 0, (11, 1), 1, (3, 31))
KILN_THERMAL = Season("kiln_lst", -1, (10, 1), 0, (5, 31))
KILN_SPECTRAL = Season("kiln", -1, (11, 1), 0, (4, 30))
NDVI_FRAME = Season("frame", 0, (1, 1), 0, (3, 31))
WATER_FRAME = Season("frame", 0, (8, 1), 0, (8, 31))

# --- Fixed values: sensors --------------------------------------------------
# name, original bands of (blue green red nir swir1 swir2 qa), scale, offset, cloud bits
SENSORS = {
    "L5": ("SR_B1 SR_B2 SR_B3 SR_B4 SR_B5 SR_B7 QA_PIXEL", 0.0000275, -0.2, 24),
    "L7": ("SR_B1 SR_B2 SR_B3 SR_B4 SR_B5 SR_B7 QA_PIXEL", 0.0000275, -0.2, 24),
    "L8": ("SR_B2 SR_B3 SR_B4 SR_B5 SR_B6 SR_B7 QA_PIXEL", 0.0000275, -0.2, 24),
    "L9": ("SR_B2 SR_B3 SR_B4 SR_B5 SR_B6 SR_B7 QA_PIXEL", 0.0000275, -0.2, 24),
    "S2": ("B2 B3 B4 B8 B11 B12 QA60", 0.0001, 0.0, 3072),
}
# sensor, first date used, last date used (exclusive), or None
SENSOR_DATES = {
    "L5": (None, "2012-12-31"), "L7": (None, None), "L8": ("2013-04-01", None), "L9": ("2021-10-01", None),
}

# --- Fixed values: class tables ---------------------------------------------
DW_CLASSES = ("water", "trees", "grass", "flooded_vegetation", "crops", "shrub_and_scrub", "built", "bare",
              "snow_and_ice")
IGBP_CLASSES = ("Water", "Evergreen_Needleleaf", "Evergreen_Broadleaf", "Deciduous_Needleleaf",
                "Deciduous_Broadleaf", "Mixed_Forest", "Closed_Shrublands", "Open_Shrublands",
                "Woody_Savannas", "Savannas", "Grasslands", "Permanent_Wetlands", "Croplands",
                "Urban_Built", "Crop_Natural_Mosaic", "Snow_Ice", "Barren", "Unclassified")
CROP_TYPES = ("non_crop", "aman_rice", "boro_rice", "aman_boro_double", "aus_rice", "aus_aman_double",
              "aus_boro_double", "other_crops")
SMOD_CLASSES = {10: "water", 11: "very_low_density", 12: "low_density", 13: "rural_cluster", 21: "suburban",
                22: "semi_dense_urban", 23: "dense_urban", 30: "urban_centre"}
BUILT_EPOCHS = (1975, 1980, 1985, 1990, 1995, 2000, 2005, 2010, 2015, 2020, 2025, 2030)
SMOD_EPOCHS = BUILT_EPOCHS[:-1]
POLLUTANT_QA = {"no2": 0.75, "so2": 0.5, "co": 0.5, "hcho": 0.5, "aerosol": 0.5}
POLLUTANT_START = "2018-05-01"

# --- Fixed values: survey codes ----------------------------------------------
DIVISION_CODES = {1: "Barishal", 2: "Chattogram", 3: "Dhaka", 4: "Khulna", 5: "Mymensingh", 6: "Rajshahi",
                  7: "Rangpur", 8: "Sylhet", 10: "Barishal", 20: "Chattogram", 30: "Dhaka", 40: "Khulna",
                  50: "Rajshahi", 55: "Rangpur", 60: "Sylhet"}
RELIGIONS = {1: "buddhist", 2: "hindu", 3: "jewish", 4: "muslim", 5: "christian", 9: "other"}
DEPRIVED_CODES = {
    "wall": (100, 110, 120, 130, 140, 150, 200, 210, 220, 230, 240, 250, 310, 320),
    "roof": (100, 110, 120, 130, 140, 200, 210, 220, 230, 310),
    "toilet": (0, 10, 11, 20, 21), "electric": (0, 1), "lit": (0, 1, 9), "edattain": (0, 1), "school": (0, 1),
    "empstat": (0, 2, 3), "labforce": (0, 1), "ownership": (0, 1),
}
DIVISION_RENAMES = {"Barisal": "Barishal", "Chittagong": "Chattogram", "Dhaka": "Dhaka", "Khulna": "Khulna",
                    "Rajshahi": "Rajshahi", "Rangpur": "Rangpur", "Sylhet": "Sylhet"}

# --- Fixed values: named discs (name | lat | lon | radius m [| type or date]) ---
WETLANDS = """
Tanguar Haor | 25.10 | 91.07 | 10000 | haor
Hakaluki Haor | 24.62 | 92.05 | 12000 | haor
Hail Haor | 24.45 | 91.80 | 8000 | haor
Shanir Haor | 24.95 | 91.35 | 6000 | haor
Dekar Haor | 25.05 | 90.95 | 7000 | haor
Chalan Beel | 24.35 | 89.15 | 15000 | beel
Barind Tract Beels | 24.80 | 88.65 | 10000 | beel
Arial Beel | 23.45 | 90.25 | 10000 | beel
Beel Dakatia | 23.12 | 90.20 | 8000 | beel
Meghna Floodplain | 23.60 | 90.65 | 12000 | floodplain
Padma Char | 23.80 | 89.70 | 10000 | floodplain
Mohanganj Haor | 24.88 | 90.68 | 8000 | haor
Teesta Floodplain | 25.80 | 89.60 | 12000 | floodplain
Bangali River Wetlands | 25.45 | 89.10 | 8000 | floodplain
Sundarbans East | 21.95 | 89.75 | 25000 | coastal
Sundarbans West | 21.80 | 89.30 | 25000 | coastal
Nijhum Dwip | 22.04 | 90.98 | 10000 | coastal
Sonadia Island | 21.47 | 91.85 | 8000 | coastal
Teknaf Wetlands | 20.85 | 92.28 | 8000 | coastal
"""
CYCLONES = """
Sidr | 22.0 | 89.8 | 50000 | 2007-11-15
Aila | 22.3 | 89.5 | 40000 | 2009-05-25
Mahasen | 22.2 | 91.3 | 30000 | 2013-05-16
Roanu | 22.5 | 91.6 | 30000 | 2016-05-21
Mora | 22.0 | 91.8 | 30000 | 2017-05-30
Fani | 21.5 | 89.8 | 40000 | 2019-05-03
Amphan | 22.0 | 89.0 | 50000 | 2020-05-20
Mocha | 21.0 | 92.0 | 50000 | 2023-05-14
"""
CITIES = """
Dhaka | 23.81 | 90.41 | 25000
Chittagong | 22.36 | 91.78 | 15000
Khulna | 22.82 | 89.56 | 12000
Rajshahi | 24.37 | 88.60 | 10000
Sylhet | 24.90 | 91.87 | 10000
Rangpur | 25.74 | 89.25 | 10000
Barishal | 22.70 | 90.37 | 8000
Comilla | 23.46 | 91.18 | 8000
Gazipur | 24.00 | 90.43 | 15000
Narayanganj | 23.63 | 90.50 | 10000
"""
ECONOMIC_ZONES = """
Dhaka EPZ | 23.95 | 90.27 | 5000
Chittagong EPZ | 22.33 | 91.78 | 5000
Mongla EPZ | 22.49 | 89.60 | 5000
Adamjee EPZ | 23.62 | 90.50 | 5000
Ishwardi EPZ | 24.13 | 89.07 | 5000
Uttara EPZ | 23.87 | 90.40 | 5000
Mirsarai EZ | 22.76 | 91.56 | 8000
"""
KILN_ZONES = """
Gazipur | 24.00 | 90.43 | 20000
Narayanganj | 23.63 | 90.50 | 15000
Savar | 23.86 | 90.26 | 15000
Manikganj | 23.86 | 89.98 | 15000
Sitakunda | 22.62 | 91.66 | 15000
Hathazari | 22.50 | 91.82 | 12000
Rajshahi_N | 24.45 | 88.62 | 18000
Chapai | 24.60 | 88.28 | 15000
Khulna_N | 23.00 | 89.55 | 15000
Jessore | 23.17 | 89.21 | 15000
"""
GROUNDWATER_ZONES = """
Barind Tract | 24.80 | 88.65 | 100000
Dhaka Metro | 23.81 | 90.41 | 50000
Chittagong | 22.36 | 91.78 | 40000
"""
ARSENIC_ZONES = """
Chandpur | 23.23 | 90.65 | 20000
Comilla | 23.46 | 91.18 | 20000
Munshiganj | 23.54 | 90.53 | 15000
Gopalganj | 23.01 | 89.82 | 15000
Faridpur | 23.60 | 89.84 | 15000
Madaripur | 23.16 | 90.19 | 15000
Satkhira | 22.72 | 89.07 | 15000
Jessore | 23.17 | 89.21 | 15000
"""
INFORMAL_AREAS = """
Korail (Dhaka) | 23.79 | 90.41 | 1000
Kamrangirchar (Dhaka) | 23.72 | 90.38 | 1500
Mirpur Slums (Dhaka) | 23.82 | 90.36 | 2000
Mohakhali Slum (Dhaka) | 23.78 | 90.40 | 800
Bhashantek (Dhaka) | 23.81 | 90.38 | 1000
Lalbagh Slums (Dhaka) | 23.72 | 90.39 | 1200
Gabtoli Slum (Dhaka) | 23.78 | 90.34 | 1000
Chittagong Port Slums | 22.33 | 91.80 | 1500
Khulna Slums | 22.82 | 89.55 | 1500
Kazir Bazar (Sylhet) | 24.89 | 91.87 | 1000
Padma Embankment (Rajshahi) | 24.37 | 88.60 | 1200
Rail-side Slums (Rangpur) | 25.74 | 89.25 | 1000
"""
# --- Fixed values: rectangles (name | west | south | east | north) -----------
RECTANGLES = """
sylhet | 90.5 | 24.0 | 92.2 | 25.2
national | 88.0 | 20.5 | 92.7 | 26.7
khulna_coastal | 88.8 | 21.8 | 89.9 | 22.9
coxs_bazar_coastal | 91.8 | 20.7 | 92.4 | 21.9
noakhali_feni | 90.8 | 22.4 | 91.6 | 23.2
Meghna Estuary | 90.50 | 22.00 | 91.30 | 23.20
Padma-Jamuna Confluence | 89.40 | 23.30 | 90.20 | 24.20
Coastal Noakhali | 90.80 | 22.00 | 91.40 | 22.90
Jamuna Braids | 89.50 | 24.20 | 90.00 | 25.20
"""
# --- Fixed values: rivers (name | buffer m | lat lon, lat lon, ...) ----------
RIVERS = """
Surma | 5000 | 24.89 91.87, 24.88 91.60, 24.85 91.40, 24.83 91.20, 24.80 91.00
Kushiyara | 5000 | 24.60 92.10, 24.55 91.90, 24.50 91.70, 24.48 91.50, 24.45 91.30
Kalni | 3000 | 24.95 90.85, 24.90 90.75, 24.85 90.65
Kangsha | 3000 | 25.00 90.70, 24.95 90.60, 24.90 90.50
Padma | 8000 | 24.07 89.00, 23.80 89.50, 23.55 90.00, 23.45 90.40, 23.20 90.60
Jamuna | 10000 | 25.40 89.70, 25.00 89.80, 24.50 89.85, 24.10 89.90, 23.80 89.75
Meghna | 8000 | 24.20 91.15, 23.80 90.80, 23.40 90.65, 23.00 90.60, 22.50 90.85
Brahmaputra | 10000 | 25.80 89.80, 25.50 89.70, 25.20 89.75
Teesta | 5000 | 26.10 88.85, 25.80 89.00, 25.50 89.30, 25.30 89.55
Ganges | 8000 | 24.60 88.20, 24.40 88.50, 24.20 88.80, 24.07 89.00
Karnaphuli | 5000 | 22.40 91.85, 22.35 91.75, 22.30 91.65
Gorai | 5000 | 23.70 89.50, 23.40 89.60, 23.00 89.55
Arial Khan | 5000 | 23.20 90.30, 23.00 90.25, 22.70 90.20
Dharla | 4000 | 25.85 89.30, 25.65 89.35, 25.50 89.40
Sangu | 4000 | 22.20 92.10, 22.00 92.00, 21.80 91.95
Matamuhuri | 4000 | 21.70 92.20, 21.50 92.15, 21.30 92.10
"""


@dataclass(frozen=True)
class Grid:
    """The base grid: ``cell_id = y * width + x``.

    ``lon0``/``lat0`` is the centre of cell (0, 0) and ``step`` the cell size in
    degrees; y grows southward. Without a step every cell has ``cell_area_m2``.
    Coordinates and areas are row-wise expressions, so no lookup join is needed.
    """
    width: int
    cell_area_m2: int = 900
    lon0: float = 0.0
    lat0: float = 0.0
    step: float | None = None
    km_per_degree: float = 111.32

    def x(self, cell="cell_id") -> Column:
        return (F.col(cell) % F.lit(self.width)).cast("int")

    def y(self, cell="cell_id") -> Column:
        return F.floor(F.col(cell) / F.lit(self.width)).cast("int")

    def lon(self, x="x") -> Column:
        return F.lit(self.lon0) + F.col(x) * F.lit(self.step)

    def lat(self, y="y") -> Column:
        return F.lit(self.lat0) - F.col(y) * F.lit(self.step)

    def area(self) -> Column:
        """Cell area in whole square metres."""
        if self.step is None:
            return F.lit(self.cell_area_m2).cast("long")
        side = self.step * self.km_per_degree * 1000.0
        return F.round(F.lit(side * side) * F.cos(F.radians(F.lit(self.lat0) - self.y() * F.lit(self.step)))
                       ).cast("long")

    def attach(self, df: DataFrame) -> DataFrame:
        """Add x, y and area_m2, computed from cell_id."""
        return df.withColumns({"x": self.x(), "y": self.y(), "area_m2": self.area()})


def zone_table(spark: SparkSession, text: str, kind: str) -> DataFrame:
    """A fixed table above as rows. kind: disc, rect or river."""
    rows = [[p.strip() for p in line.split("|")] for line in text.strip().splitlines()]
    if kind == "disc":
        data = [(i, r[0], float(r[1]), float(r[2]), float(r[3]), r[4] if len(r) > 4 else None)
                for i, r in enumerate(rows)]
        return spark.createDataFrame(data, "zone_id int, zone string, lat double, lon double, "
                                           "radius_m double, note string")
    if kind == "rect":
        data = [(i, r[0], *map(float, r[1:5])) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, "zone_id int, zone string, west double, south double, "
                                           "east double, north double")
    if kind == "river":
        data = [(i, r[0], float(r[1]), n, *map(float, p.split()))
                for i, r in enumerate(rows) for n, p in enumerate(r[2].split(","))]
        return spark.createDataFrame(data, "zone_id int, zone string, buffer_m double, n int, "
                                           "lat double, lon double")
    raise ValueError(f"unknown zone kind: {kind}")
