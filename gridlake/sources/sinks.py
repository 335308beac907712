"""Table sinks."""
from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header. ``single_file`` is for report tables of bounded size only."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by=("product", "year"), sort_by=("tile_id", "cell_id")) -> None:
    """Parquet partitioned by the given columns and sorted inside files, so that later
    reads prune partitions and skip row groups."""
    parts = [c for c in partition_by if c in df.columns]
    order = [c for c in sort_by if c in df.columns]
    if order:
        df = df.repartitionByRange(*parts, *order).sortWithinPartitions(*parts, *order)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
