"""Registry of queries and of the SQL each one must agree with."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridlake.sources.fixtures import VIEWS, Tables, view_sql


class Catalog:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}
        self.builders: dict[str, Callable[[Tables], DataFrame]] = {}

    def add(self, name: str, build: Callable[[Tables], DataFrame], views: str = "", body: str | None = None):
        """``body`` is a SELECT, or ``cte AS (...), ... SELECT``; the named views go before it."""
        if name in self.queries:
            raise KeyError(name)
        self.builders[name] = build
        self.queries[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if body is not None:
            self.sql[name] = with_views(views, body)


def with_views(views: str, body: str) -> str:
    body = body.strip()
    ctes = [f"{v} AS ({view_sql(v)})" for v in views.split()]
    if not body.upper().startswith("SELECT"):
        return "WITH RECURSIVE " + ",\n".join(ctes + [body])
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


# --- SQL fragments shared by the reference queries ----------------------------

def nd(a: str, b: str) -> str:
    return f"(({a}-{b})/nullif({a}+{b},0))"


def km2(condition: str, area: str = "900") -> str:
    """Conditional area."""
    return f"CAST(sum(CASE WHEN {condition} THEN {area} ELSE 0 END) AS DOUBLE)/1e6"


def clamp(x: str, lo, hi) -> str:
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE least(greatest({x},CAST({lo} AS DOUBLE)),CAST({hi} AS DOUBLE)) END)"


def norm(x: str, lo, hi) -> str:
    return clamp(f"(({x}-CAST({lo} AS DOUBLE))/CAST({float(hi) - float(lo)!r} AS DOUBLE))", 0, 1)


def r(x: str) -> str:
    """Seven significant digits, as ``algebra.rounded``."""
    return f"CAST(CAST(round({x},10) AS FLOAT) AS DOUBLE)+0e0"


BANDS = ("blue", "green", "red", "nir", "swir1", "swir2")
MEDIANS = ", ".join(f"quantile_cont({b},0.5) AS {b}" for b in BANDS)
AWEI = "(4e0*(green-swir1)-(0.25e0*nir+2.75e0*swir2))"


def vote(a: str = "0", b: str = "0", c: str = "0") -> str:
    return (f"CAST((CAST({nd('green', 'nir')}>={a} AS INT)+CAST({nd('green', 'swir1')}>={b} AS INT)"
            f"+CAST({AWEI}>={c} AS INT))>=2 AS INT)")


def season_case(season, years=None) -> str:
    """FROM-clause lateral rows (season, yr) of a date t; mirrors the window definitions."""
    parts = []
    for back in range(season.start_off, season.end_off + 1):
        y = f"(CAST(year(t) AS INT)-({back}))"
        s, e = season.start, season.end
        parts.append(f"SELECT '{season.name}' AS season, {y} AS sy WHERE t>=make_date({y}+({season.start_off}),{s[0]},{s[1]}) "
                     f"AND t<make_date({y}+({season.end_off}),{e[0]},{e[1]})")
    return " UNION ALL ".join(parts)


def seasonal(source: str, seasons, columns: str = "*") -> str:
    """SELECT rows of ``source`` tagged with season and season year ``sy``."""
    seasons = seasons if isinstance(seasons, (list, tuple)) else [seasons]
    tables = " UNION ALL ".join(
        f"SELECT {columns}, '{s.name}' AS season, CAST(year(t) AS INT)-({back}) AS sy FROM {source} "
        f"WHERE t>=make_date(CAST(year(t) AS INT)-({back})+({s.start_off}),{s.start[0]},{s.start[1]}) "
        f"AND t<make_date(CAST(year(t) AS INT)-({back})+({s.end_off}),{s.end[0]},{s.end[1]})"
        for s in seasons for back in range(s.start_off, s.end_off + 1))
    return tables


ZONE_CELLS = ("zc AS (SELECT zone_id, zone, division, cell_id, c.x, c.y FROM cells c JOIN zones z "
              "ON c.x BETWEEN z.x0 AND z.x1 AND c.y BETWEEN z.y0 AND z.y1)")
DISC_CELLS = ("dc AS (SELECT disc_id, disc, cx, cy, r, event_date, cell_id, c.x, c.y FROM cells c JOIN discs d "
              "ON (c.x-d.cx)*(c.x-d.cx)+(c.y-d.cy)*(c.y-d.cy) <= d.r*d.r)")


def opening_sql(source: str, value: str, keys: str = "yr", out: str = "op") -> str:
    """CTEs for erosion and dilation with the plus-shaped element; result table ``out``."""
    k = [x.strip() for x in keys.split(",") if x.strip()]
    def step(name, src, agg):
        on = " AND ".join([f"a.{x}=b.{x}" for x in k] + ["b.x=a.x+o.dx", "b.y=a.y+o.dy"])
        cols = ", ".join([f"a.{x}" for x in k] + ["a.cell_id", "a.x", "a.y"])
        return (f"{name} AS (SELECT {cols}, {agg}(b.{value}) AS {value} FROM {src} a JOIN "
                f"(VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dx,dy) ON true JOIN {src} b ON {on} GROUP BY {cols})")
    return step(f"{out}_er", source, "min") + ",\n" + step(out, f"{out}_er", "max")
