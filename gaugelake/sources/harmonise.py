"""Five public solubility tables in one schema of observations.

Each source is a row of :data:`SOURCES`: which raw column fills which column of the schema, and what is the same for all of its rows. Rows are numbered
from 1 in the order of the raw file (column ``source_row``, which the reader adds).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.functions.columns import number_or_null, present, record_id
from gaugelake.operators.checks import union

# The columns of an observation, in order; those of other types than string.
COLUMNS = """observation_id source_dataset source_file source_row source_record_id original_smiles source_inchi source_inchi_key molecule_name casrn log_s
target_original_value target_original_unit target_source_column conversion_rule endpoint_definition temperature temperature_unit ph ph_unit ionic_strength
ionic_strength_unit measurement_sd replicate_count article_id pubmed_id dataset_partition quality_code source_group source_comment reference_prediction""".split()
TYPES = {"source_row": "long"} | dict.fromkeys(("log_s", "temperature", "ph", "ionic_strength", "measurement_sd", "replicate_count", "reference_prediction"), "double")


@dataclass
class Source:
    """file: name of the raw file. target: raw column of the measured value. texts, numbers: schema column to raw column. same: schema column to one value for all rows.
    names: raw columns that may hold the record's id, in order; ``own_id`` stands in where they are blank. sign: of the raw value in log_s."""

    file: str
    target: str
    texts: dict[str, str] = field(default_factory=dict)
    numbers: dict[str, str] = field(default_factory=dict)
    same: dict[str, str] = field(default_factory=dict)
    names: tuple[str, ...] = ()
    own_id: bool = False
    trimmed: tuple[str, ...] = ()
    sign: int = 1
    value: str | None = None
    unit: str | None = None


_IDENTITY = {"target_original_unit": "log10(mol/L)", "conversion_rule": "identity"}
_PLAIN = _IDENTITY | {"endpoint_definition": "not provided in repository"}
_TWO = {"texts": {"original_smiles": "smiles"}, "same": _PLAIN, "own_id": True, "trimmed": ("original_smiles",)}

# Raw columns (spelled as in the files), units, rules and definitions of each source.
SOURCES: dict[str, Source] = {
    "AqSolDB": Source(
        "AqSolDB.csv", "Solubility", {"original_smiles": "SMILES", "source_inchi": "InChI", "source_inchi_key": "InChIKey", "molecule_name": "Name", "source_group": "Group"},
        {"measurement_sd": "SD", "replicate_count": "Ocurrences"}, _PLAIN, ("ID",),
    ),
    "Delaney": Source(
        "Delaney.csv", "measured log solubility in mols per litre", {"original_smiles": "smiles", "molecule_name": "Compound ID"}, {"reference_prediction": "ESOL predicted log solubility in mols per litre"},
        _IDENTITY | {"endpoint_definition": "aqueous solubility; repository gives no pH metadata"}, ("Compound ID",), trimmed=("original_smiles",),
    ),
    "AQUA": Source("aqua_org.csv", "logS", **_TWO),
    "PHYSPROP": Source("phys_org.csv", "logS", **_TWO),
    "OCHEM": Source(
        "ochem_all.csv", "Water solubility {measured, converted}",
        {
            "original_smiles": "SMILES", "molecule_name": "NAME", "casrn": "CASRN", "temperature_unit": "UNIT {Temperature}", "ph_unit": "UNIT {pH}", "ionic_strength_unit": "UNIT {Ionic strength}", "article_id": "ARTICLEID",
            "pubmed_id": "PUBMEDID", "dataset_partition": "Dataset", "quality_code": "Quality code", "source_comment": "comment (chemical)",
        },
        {"temperature": "Temperature", "ph": "pH", "ionic_strength": "Ionic strength"},
        {"conversion_rule": "log_s = -1 * converted_minus_log10_molar", "endpoint_definition": "water solubility; intrinsic/apparent status not provided"},
        ("EXTERNALID", "CASRN"), True, ("original_smiles",), -1, "Water solubility {measured}", "UNIT {Water solubility}",
    ),
}


def _text(df: DataFrame, name: str) -> Column:
    return present(df, name, "string")


def harmonise(df: DataFrame, dataset: str, file: str | None = None, source: Source | None = None) -> DataFrame:
    """Raw rows (with ``source_row``) in the schema of observations; a raw column that is not there is null, a number that is none is null."""
    how = source or SOURCES[dataset]
    made: dict[str, Column] = {c: F.lit(v) for c, v in how.same.items()}
    made |= {c: F.trim(_text(df, raw)) if c in how.trimmed else _text(df, raw) for c, raw in how.texts.items()}
    made |= {c: number_or_null(_text(df, raw)) for c, raw in how.numbers.items()}
    row = F.col("source_row").cast("long")
    # Blank ids count as missing only where another may stand in.
    ids = [F.nullif(_text(df, n), F.lit("")) if how.own_id else _text(df, n) for n in how.names]
    if how.own_id:
        ids.append(F.format_string(f"{dataset}-%07d", row))
    value = number_or_null(_text(df, how.target))
    made |= {
        "observation_id": record_id(F.lit(dataset), row), "source_dataset": F.lit(dataset), "source_file": F.lit(file or how.file), "source_row": row, "source_record_id": F.coalesce(*ids),
        "log_s": -value if how.sign < 0 else value, "target_original_value": _text(df, how.value or how.target), "target_source_column": F.lit(how.target),
    }
    if how.unit:
        made["target_original_unit"] = _text(df, how.unit)
    return df.select(*[made.get(c, F.lit(None)).cast(TYPES.get(c, "string")).alias(c) for c in COLUMNS])


#: Harmonisers by the name of their source.
HARMONISERS: dict[str, Callable[..., DataFrame]] = {name: (lambda df, file=None, _n=name: harmonise(df, _n, file)) for name in SOURCES}


def numbered(df: DataFrame, column: str = "source_row") -> DataFrame:
    """``df``, read from one file, with its rows numbered from 1 in the file's order.

    Partitions of a file scan come in order, so a row's number is its place in its partition and the rows of those before: one pass that counts.
    """
    placed = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    ahead = sizes.alias("a").join(sizes.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy(F.col("a._part").alias("_part"), F.col("a.first").alias("first")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("ahead"))  # a row a partition
    return placed.join(F.broadcast(ahead), "_part").withColumn(column, F.col("ahead") + F.col("_at") - F.col("first") + 1).drop("_at", "_part", "first", "ahead")


def load_sources(spark: SparkSession, folder: str, expected: dict[str, int] | None = None) -> DataFrame:
    """All five raw files of a folder, harmonised; ``expected``: rows of each, checked."""
    from gaugelake.sources.readers import read_csv

    parts = []
    for name, how in SOURCES.items():
        raw = numbered(read_csv(spark, f"{folder.rstrip('/')}/{how.file}"))
        if expected and name in expected and (n := raw.count()) != expected[name]:
            raise ValueError(f"{how.file} has {n} rows, not {expected[name]}")
        parts.append(harmonise(raw, name))
    return union(parts)
