"""Tables whose files were written under several versions of their schema (O-04).

``schemas.conform`` fills a declared default wherever a column is missing *or null*, as it
can't tell the one from the other.  Here every file generation has a folder and a schema
of its own: a column that a generation did not have yet takes its declared default, one
that it had is read as written, nulls included.  Generations only add columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import GENERATIONS


def schema_of(table: str, generation: int) -> T.StructType:
    """The columns that a generation's files have."""
    late = {c for g, added in GENERATIONS[table]["added"].items() if g > generation for c in added}
    return T.StructType([f for f in GENERATIONS[table]["schema"].fields if f.name not in late])


def latest(table: str) -> int:
    return max(GENERATIONS[table]["added"], default=1)


def write_generation(df: DataFrame, root: str, table: str, generation: int, mode: str = "append") -> None:
    """Append rows as that generation writes them: its columns and no others."""
    schema = schema_of(table, generation)
    missing = set(schema.fieldNames()) - set(df.columns)
    if missing:
        raise ValueError(f"{table} generation {generation} also has {sorted(missing)}")
    (df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
     .write.mode(mode).parquet(f"{root.rstrip('/')}/generation={generation}"))


def read_generations(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All generations under the newest schema."""
    full = GENERATIONS[table]["schema"]
    parts = []
    for g in range(1, latest(table) + 1):
        have = schema_of(table, g)
        try:
            df = spark.read.schema(have).parquet(f"{root.rstrip('/')}/generation={g}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        defaults = {c: v for k, added in GENERATIONS[table]["added"].items() if k > g for c, v in added.items()}
        parts.append(df.select(*[(F.lit(defaults[f.name]) if f.name in defaults else F.col(f.name)).cast(f.dataType).alias(f.name) for f in full.fields]))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], full)
