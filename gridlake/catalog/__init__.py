"""Every inventory entry as a runnable query with its reference SQL."""
from gridlake.catalog.base import Catalog


def build() -> Catalog:
    from gridlake.catalog import acquisition, alerts, climate, coast, composite, crops, land, lights, primitives, products, survey, water
    catalog = Catalog()
    for module in (primitives, acquisition, water, coast, crops, land, lights, climate, composite, alerts, survey, products):
        module.register(catalog)
    return catalog
