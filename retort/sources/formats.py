"""Reading and writing molecule tables: CSV, TSV, SMI, SDF, Parquet, and JSON for writing.

Every reader gives row_idx, smiles and name beside the file's own columns. Text cells are strings and empty ones stay "".
Records of an SDF file that can't be read give a row with null columns, as texts that are no molecules do.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.functions import smiles as S
from retort.functions.elements import NUMBER, VALENCES

EXTENSIONS = {".csv": "csv", ".tsv": "tsv", ".smi": "smi", ".smiles": "smi", ".sdf": "sdf", ".mol": "sdf", ".parquet": "parquet", ".pq": "parquet", ".json": "json"}


@dataclass
class Format:
    kind: str
    has_header: bool = True
    smiles_column: str = "smiles"
    name_column: str | None = None

    @property
    def delimiter(self) -> str:
        return {"tsv": "\t", "smi": " "}.get(self.kind, ",")


def detect(path: str) -> str:
    kind = EXTENSIONS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if kind is None:
        raise ValueError(f"unknown format: {path}; known: {', '.join(EXTENSIONS)}")
    return kind


def config(path: str, kind: str | None = None, has_header: bool | None = None, smiles_column: str = "smiles", name_column: str | None = None) -> Format:
    kind = kind or detect(path)
    return Format(kind, False if kind == "smi" else True if has_header is None else has_header, smiles_column, name_column)


def read_molecules(spark: SparkSession, path: str, kind: str | None = None, has_header: bool | None = None, smiles_column: str = "smiles", name_column: str | None = None) -> DataFrame:
    c = config(path, kind, has_header, smiles_column, name_column)
    if c.kind == "parquet":
        df = spark.read.parquet(path)
    elif c.kind == "smi":
        return _read_smi(spark, path)
    elif c.kind == "sdf":
        return _read_sdf(spark, path)
    else:
        df = spark.read.csv(path, sep=c.delimiter, header=c.has_header, quote='"', escape='"', multiLine=False, inferSchema=False)
        if not c.has_header:
            df = df.toDF("smiles", *(f"col_{k}" for k in range(1, len(df.columns))))
        df = df.select(*(F.coalesce(F.col(f"`{x}`"), F.lit("")).alias(x) for x in df.columns))
    smiles = F.coalesce(F.col(f"`{c.smiles_column}`").cast("string"), F.lit("")) if c.smiles_column in df.columns else F.lit("")
    name = c.name_column or ("name" if "name" in df.columns else None)
    df = df.withColumn("smiles", smiles)
    df = df.withColumn("name", F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in df.columns else F.lit(""))
    return with_row_idx(df)


def with_row_idx(df: DataFrame) -> DataFrame:
    """df with row_idx, growing in file order; dense only within a partition, so that no pass over the data is needed."""
    return df if "row_idx" in df.columns else df.select(F.monotonically_increasing_id().alias("row_idx"), *df.columns)


def _read_smi(spark: SparkSession, path: str) -> DataFrame:
    """SMILES, and after the first white space a name; blank lines are none."""
    line = F.trim(F.col("value"))
    df = spark.read.text(path).where(line != "").select(F.split(line, r"\s+", 2).alias("p"))
    return with_row_idx(df.select(F.col("p")[0].alias("smiles"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("name")))


def row_count(spark: SparkSession, path: str, kind: str | None = None) -> int:
    """Records of a file, without parsing molecules: Parquet is counted from its footers."""
    kind = kind or detect(path)
    if kind == "sdf":
        return spark.read.option("lineSep", "$$$$\n").text(path).where(F.rlike("value", F.lit(r"\S"))).count()
    return read_molecules(spark, path, kind).count()


def reference_structure(spark: SparkSession, path: str, kind: str | None = None) -> str:
    """The SMILES of the first record of a file, as what others are compared with."""
    row = read_molecules(spark, path, kind).where("smiles <> ''").orderBy("row_idx").select("smiles").first()
    if row is None:
        raise ValueError(f"no molecule in {path}")
    return row["smiles"]


SDF = "symbols array<string>, xyz array<array<double>>, bonds array<array<int>>, charges array<array<int>>"


def _read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """V2000 records: name, atoms' symbols and coordinates, bonds (from, to, order), charges (atom, charge), properties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"smiles": smiles_of(r), **r} for r in map(parse_record, batch.column("value").to_pylist()) if r is not None]
            yield pa.RecordBatch.from_pylist(rows, schema)

    pairs = pa.map_(pa.string(), pa.string())
    schema = pa.schema([("smiles", pa.string()), ("name", pa.string()), ("symbols", pa.list_(pa.string())), ("xyz", pa.list_(pa.list_(pa.float64()))), ("bonds", pa.list_(pa.list_(pa.int32()))), ("charges", pa.list_(pa.list_(pa.int32()))), ("properties", pairs)])
    text = spark.read.option("lineSep", "$$$$\n").text(path)
    return with_row_idx(text.mapInArrow(run, f"smiles string, name string, {SDF}, properties map<string,string>"))


def smiles_of(record: dict) -> str | None:
    """The record's graph as SMILES; hydrogens with one bond are counted, not written. Null where it is no molecule."""
    symbols, bonds = record.get("symbols"), record.get("bonds", [])
    if not symbols:
        return None
    try:
        ends = [x for a, b, _ in bonds for x in (a, b)]
        folded = {k for k, x in enumerate(symbols) if x == "H" and len(symbols) > 1 and ends.count(k) == 1}
        charge = dict(map(tuple, record["charges"]))
        m, place = S.Mol(), {}
        for k, x in enumerate(symbols):
            if k not in folded:
                own = [o for a, b, o in bonds if k in (a, b) and not {a, b} & folded]
                given = sum(k in (a, b) and bool({a, b} & folded) for a, b, _ in bonds)
                z, q = NUMBER[x], charge.get(k, 0)
                # a charge changes the usual valence: nitrogen and later gain a bond by a positive one
                room = VALENCES.get(z, (0,))[0] + (q if z in (7, 8, 9, 15, 16) else -abs(q)) - sum(own)
                place[k] = m.add(z, charge=q, h=given or (max(room, 0) if q else None if z in VALENCES else 0))
        for a, b, o in bonds:
            if not {a, b} & folded:
                m.bond(place[a], place[b], o)
        return S.write(S.finished(m))
    except (S.Invalid, KeyError, IndexError, RecursionError):
        return None


def parse_record(text: str) -> dict | None:
    """None for blank text, and no fields for what is not a record."""
    if not text.strip():
        return None
    try:
        return _fields(text.strip("\n").split("\n"))
    except (ValueError, IndexError):
        return {}


def _fields(lines: list[str]) -> dict:
    start = next((k for k, x in enumerate(lines) if x.rstrip().endswith("V2000")), None)
    if start is None:
        return {}
    # the name is three lines before the counts; leading blank names are lost with the strip above
    n_atoms, n_bonds = int(lines[start][:3]), int(lines[start][3:6])
    a, b = lines[start + 1 : start + 1 + n_atoms], lines[start + 1 + n_atoms : start + 1 + n_atoms + n_bonds]
    if len(a) < n_atoms or len(b) < n_bonds:
        return {}
    charges, properties, key = [], {}, None
    for line in lines[start + 1 + n_atoms + n_bonds :]:
        if line.startswith("M  CHG"):
            numbers = list(map(int, line.split()[3:]))
            charges += [[i - 1, q] for i, q in zip(numbers[::2], numbers[1::2], strict=True)]
        elif line.startswith(">") and "<" in line:
            key = line[line.index("<") + 1 : line.rindex(">")]
            properties[key] = ""
        elif key is not None and line.strip():
            properties[key] += ("\n" if properties[key] else "") + line
        else:
            key = None
    return {
        "name": lines[start - 3].strip() if start >= 3 else "",
        "symbols": [x[31:34].strip() for x in a],
        "xyz": [[float(x[k : k + 10]) for k in (0, 10, 20)] for x in a],
        "bonds": [[int(x[:3]) - 1, int(x[3:6]) - 1, int(x[6:9])] for x in b],
        "charges": charges,
        "properties": list(properties.items()),
    }


def write_molecules(df: DataFrame, path: str, kind: str | None = None, columns: list[str] | None = None) -> None:
    """Overwrites path. Arrays are joined by ";" where the format has only text."""
    kind = kind or detect(path)
    if columns:
        df = df.select(*columns, *(c for c in df.columns if c not in columns))
    if kind in ("parquet", "json"):
        df.write.mode("overwrite").format(kind).save(path)
    elif kind == "smi":
        rows = df.where(F.col("smiles") != "")
        text = F.concat_ws(" ", "smiles", F.expr("nullif(name, '')")) if "name" in df.columns else F.col("smiles")
        rows.select(text.alias("value")).write.mode("overwrite").text(path)
    elif kind == "sdf":
        df.select(record().alias("value")).write.mode("overwrite").option("lineSep", "$$$$\n").text(path)
    else:
        flat = [F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if t.startswith("array") else F.to_json(c).alias(c) if t.startswith(("map", "struct")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").csv(path, sep="\t" if kind == "tsv" else ",", header=True, quote='"', escape='"', emptyValue="", nullValue="")


def record() -> Column:
    """A V2000 record from name, symbols, xyz, bonds, charges and properties, as built-in formatting."""
    atom = lambda s, p: F.concat(*(F.format_string("%10.4f", p[k]) for k in range(3)), F.lit(" "), F.rpad(s, 3, " "), F.lit(" 0  0  0  0  0  0  0  0  0  0  0  0"))
    bond = lambda b: F.format_string("%3d%3d%3d  0", b[0] + 1, b[1] + 1, b[2])
    charge = lambda c: F.format_string("M  CHG  1%4d%4d", c[0] + 1, c[1])
    counts = F.format_string("%3d%3d  0  0  0  0  0  0  0  0999 V2000", F.size("symbols"), F.size("bonds"))
    prop = lambda e: F.concat(F.lit(">  <"), e["key"], F.lit(">\n"), e["value"], F.lit("\n"))
    parts = F.concat(F.array(F.col("name"), F.lit("  retort"), F.lit(""), counts), F.zip_with("symbols", "xyz", atom), F.transform("bonds", bond), F.transform("charges", charge), F.array(F.lit("M  END")), F.transform(F.map_entries("properties"), prop), F.array(F.lit("")))
    return F.array_join(parts, "\n")
