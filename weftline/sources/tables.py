"""CSV and JSON files of a run: key files, rosters, manifests, snapshots; guarded and atomic writes."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources import jsonl


def unique_csv(spark: SparkSession, path: str, required: list[str], key: str) -> DataFrame:
    """A CSV with a header; missing columns, blank keys and keys that come twice fail."""
    df = spark.read.csv(path, header=True)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    bad = df.groupBy(F.trim(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1 or coalesce(key, '') = ''").limit(8).collect()
    if bad:
        raise ValueError(f"{path}: {key} is blank or comes twice: {sorted(str(r['key']) for r in bad)}")
    return df


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in a fixed order, null as an empty field."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    df.select(*text).write.option("emptyValue", "").csv(path, header=True)


def export(frames: dict[str, DataFrame], folder: str, csv: dict[str, list[str]]) -> None:
    """Every table as JSON lines with keys in order, and those named in ``csv`` also as CSV of the columns given."""
    for name, df in frames.items():
        jsonl.write_sorted(df, f"{folder}/{name}.jsonl")
        if name in csv:
            write_csv(df, f"{folder}/{name}.csv", csv[name])


def load_json(where: str) -> dict:
    """A JSON object given inline, as a file URI or as a path."""
    text = where
    if not where.lstrip().startswith("{"):
        with open(re.sub(r"^file://", "", where), encoding="utf-8") as f:
            text = f.read()
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("a JSON object is wanted")
    return found


def write_json(path: str, value: object) -> None:
    """Written beside its place, forced to disk, then renamed: a reader sees the old file or the new one."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, ensure_ascii=False)
        f.write("\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)


def write_env(path: str, values: dict[str, object]) -> None:
    """Settings as lines that a shell can read, quoted; written beside their place, then renamed."""
    import shlex

    bad = [k for k in values if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", k)]
    if bad:
        raise ValueError(f"no names of variables: {', '.join(bad)}")
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.writelines(f"export {k}={shlex.quote(str(v))}\n" for k, v in values.items())
    os.replace(f"{path}.part", path)


def student_keys(spark: SparkSession, roster: str, out: str, key: str = "student_id") -> int:
    """Give every student of a roster, a CSV of unique ids, a new random key, as a CSV; gives their number. A roster is one class."""
    import secrets

    names = sorted(r[0] for r in unique_csv(spark, roster, [key], key).select(F.trim(key)).collect())
    with open(f"{out}.part", "w", encoding="utf-8") as f:
        f.write(f"{key},api_key\n")
        f.writelines(f'"{n}",{secrets.token_urlsafe(24)}\n' for n in names)
    os.replace(f"{out}.part", out)
    return len(names)


def csv_rows(spark: SparkSession, path: str) -> int:
    """Rows of a CSV, its header aside."""
    return spark.read.csv(path, header=True).count()


def clear_folder(folder: str, known: re.Pattern) -> None:
    """Empty a folder for writing; any file that does not look like our own refuses it."""
    if not os.path.isdir(folder):
        os.makedirs(folder)
        return
    foreign = [f for f in sorted(os.listdir(folder)) if not known.fullmatch(f)]
    if foreign:
        raise FileExistsError(f"{folder} holds files that are not ours: {', '.join(foreign[:8])}")
    for f in os.listdir(folder):
        at = os.path.join(folder, f)
        shutil.rmtree(at) if os.path.isdir(at) else os.remove(at)


def fingerprint(spark: SparkSession, folder: str, **settings: object) -> str:
    """What a result depends on: settings, and the path, size and time of every input file, of a folder or of a URI."""
    if "://" in folder:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.unix_micros("modificationTime").alias("at"))
        found = files.agg(F.count("*"), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "at"))).first()
        seen: list = [folder, *found]
    else:
        seen = sorted((os.path.relpath(p, folder), os.stat(p).st_size, os.stat(p).st_mtime_ns) for at, _, fs in os.walk(folder) for p in (os.path.join(at, f) for f in fs))
    return hashlib.sha256(json.dumps([settings, seen], sort_keys=True, default=str).encode()).hexdigest()


def save_tables(tables: dict[str, DataFrame], folder: str, version: int = 1) -> None:
    """A snapshot of several tables, published by one manifest written last; ``folder`` is shared."""
    at = f"snapshot-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{at}/{name}")
    write_json(f"{folder}/snapshot.json", {"version": version, "folder": at, "tables": sorted(tables)})


def load_tables(spark: SparkSession, folder: str, known: set[str] | None = None, version: int = 1) -> dict[str, DataFrame]:
    """The tables of the published snapshot; another version fails, and so does any other set of tables than ``known``."""
    manifest = load_json(f"{folder}/snapshot.json")
    if manifest["version"] != version:
        raise ValueError(f"snapshot version {manifest['version']}, not {version}")
    if known is not None and set(manifest["tables"]) != known:
        raise ValueError(f"the snapshot's tables differ from those known in {', '.join(sorted(known ^ set(manifest['tables'])))}")
    return {name: spark.read.parquet(f"{folder}/{manifest['folder']}/{name}") for name in manifest["tables"]}
