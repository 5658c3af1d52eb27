"""Binary token shards: little-endian unsigned 32-bit tokens without a header, and the index beside them."""

from __future__ import annotations

import glob
import hashlib
import os
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import shuffle
from weftline.operators.prefix import prefix_sum
from weftline.operators.tokens import locate, shard_pieces
from weftline.sources.tables import load_json, write_json

#: Format of the index. Fixed values.
INDEX = {"schema_version": 1, "token_dtype": "uint32", "byte_order": "little", "shard_format": "flat-binary"}
_PATH = re.compile(r"[A-Za-z0-9._-]+(?:/[A-Za-z0-9._-]+)*")


class IndexError_(ValueError):
    """An index or shard that cannot be trusted."""


def _writer(folder: str, piece: Callable[[dict], bytes]):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by shard and place: one open file, its hash kept as it grows."""
        at, out, digest, counts, own = None, None, None, {}, uuid.uuid4().hex

        def close() -> pd.DataFrame:
            out.close()
            os.replace(f"{folder}/.{name(at)}.{own}", f"{folder}/{name(at)}")
            total = sum(counts.values())
            return pd.DataFrame({"shard": [at], "path": [name(at)], "tokens": [total], "sha256": [digest.hexdigest()], "source_token_counts": [dict(sorted(counts.items()))]})

        def name(k: int) -> str:
            return f"tokens-{k:06d}.bin"

        for pdf in batches:
            for row in pdf.to_dict("records"):
                shard, source, data = row["shard"], row["source_id"], piece(row)
                if shard != at:
                    if out:
                        yield close()
                    at, digest, counts = shard, hashlib.sha256(), {}
                    out = open(f"{folder}/.{name(at)}.{own}", "wb")
                out.write(data)
                digest.update(data)
                counts[source] = counts.get(source, 0) + len(data) // 4
        if out:
            yield close()

    return write


def write_shards(documents: DataFrame, order: list[str], folder: str, size: int = 100_000_000) -> dict:
    """Write (source_id, *order, tokens) as shards of ``size`` tokens into a shared folder, and the index; gives the index.

    Addresses come from a two-phase prefix sum.  A shard's pieces are sorted and streamed through one open file, so memory
    does not grow with the shard; a file appears under its name only when it is whole, so a task may run again.
    """
    os.makedirs(folder, exist_ok=True)
    pack = F.pandas_udf(_pack, "binary")
    sized = documents.select(*order, F.size("tokens").cast("long").alias("n"))
    rows = documents.select("source_id", *order, pack("tokens").alias("bytes")).join(prefix_sum(sized, order, "n"), order)
    pieces = shard_pieces(rows, size).select("shard", "place", F.coalesce(F.nullif(F.trim("source_id"), F.lit("")), F.lit("unknown")).alias("source_id"), F.substring("bytes", (F.col("from") * 4 + 1).cast("int"), (F.col("taken") * 4).cast("int")).alias("piece"))
    return _publish(pieces, folder, lambda row: row["piece"])


def _publish(pieces: DataFrame, folder: str, piece: Callable[[dict], bytes]) -> dict:
    """Write pieces (shard, place, source_id, ...) as shards, then the index."""
    written = pieces.repartition("shard").sortWithinPartitions("shard", "place").mapInPandas(_writer(folder, piece), "shard long, path string, tokens long, sha256 string, source_token_counts map<string,long>")
    shards = [r.asDict() for r in written.collect()]  # one row for 400 MB of tokens
    shards.sort(key=lambda r: r.pop("shard"))
    counts: dict[str, int] = {}
    for s in shards:
        s |= {"dtype": "uint32", "byte_order": "little", "source_token_counts": dict(s["source_token_counts"])}
        for k, v in s["source_token_counts"].items():
            counts[k] = counts.get(k, 0) + v
    index = INDEX | {"total_tokens": sum(s["tokens"] for s in shards), "source_token_counts": dict(sorted(counts.items())), "shards": shards}
    write_json(f"{folder}/index.json", index)
    return index


def _pack(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: np.asarray(t, "<u4").tobytes())


def local_path(uri: str) -> str:
    """The path of a file URI or a plain path; other schemes are refused."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file") and parsed.netloc in ("", "localhost"):
        return unquote(parsed.path) if parsed.scheme else uri
    raise IndexError_(f"{uri} is not on a mounted file system")


def load_index(uri: str, full: bool = False) -> dict:
    """An index checked against its files: format, paths, sizes and sums; with ``full`` the hashes too."""
    path = local_path(uri)
    index = load_json(path)
    for key, value in INDEX.items():
        if index.get(key) != value:
            raise IndexError_(f"{key} is {index.get(key)!r}, not {value!r}")
    folder = os.path.dirname(path)
    for s in index["shards"]:
        at = str(s.get("path"))
        if not _PATH.fullmatch(at) or ".." in at.split("/"):
            raise IndexError_(f"unsafe path {at!r}")
        tokens = s.get("tokens")
        if isinstance(tokens, bool) or not isinstance(tokens, int) or tokens <= 0:
            raise IndexError_(f"{at}: tokens must be a positive integer")
        if not re.fullmatch("[0-9a-f]{64}", str(s.get("sha256"))):
            raise IndexError_(f"{at}: sha256 must be lower-case hex")
        if os.path.getsize(f"{folder}/{at}") != 4 * tokens:
            raise IndexError_(f"{at}: size does not fit {tokens} tokens")
        if full:
            digest = hashlib.sha256()
            with open(f"{folder}/{at}", "rb") as f:
                while block := f.read(1 << 20):
                    digest.update(block)
            if digest.hexdigest() != s["sha256"]:
                raise IndexError_(f"{at}: hash differs")
    if index["total_tokens"] != sum(s["tokens"] for s in index["shards"]):
        raise IndexError_("total_tokens is not the sum of the shards")
    return index


def read_index(uri: str, most: int = 64 << 20, seconds: float = 30) -> dict:
    """An index by path, file URI or over http(s), its form checked but not its files; other schemes are refused, and so is an
    answer of more than ``most`` bytes."""
    if urlparse(uri).scheme not in ("http", "https"):
        text = open(local_path(uri), encoding="utf-8").read()
    else:
        from urllib.request import urlopen

        with urlopen(uri, timeout=seconds) as answer:
            data = answer.read(most + 1)
        if len(data) > most:
            raise IndexError_(f"{uri} is larger than {most} bytes")
        text = data.decode("utf-8")
    index = load_json(text) if text.lstrip().startswith("{") else {}
    for key, value in INDEX.items():
        if index.get(key) != value:
            raise IndexError_(f"{key} is {index.get(key)!r}, not {value!r}")
    if not isinstance(index.get("shards"), list) or index.get("total_tokens") != sum(s.get("tokens", 0) for s in index["shards"]):
        raise IndexError_("total_tokens is not the sum of the shards")
    return index


def shard_table(spark: SparkSession, uri: str) -> DataFrame:
    """(shard, path, offset, tokens) of an index, offsets as running sums."""
    index, folder, offset, rows = load_index(uri), os.path.dirname(local_path(uri)), 0, []
    for k, s in enumerate(index["shards"]):
        rows.append((k, f"{folder}/{s['path']}", offset, s["tokens"]))
        offset += s["tokens"]
    return spark.createDataFrame(rows, "shard long, path string, offset long, tokens long")


def read_range(spark: SparkSession, uri: str, start: int = 0, stop: int | None = None, block: int = 1 << 20) -> DataFrame:
    """(position, token) of [start, stop): only the blocks of the shards that the range touches are read."""
    shards = shard_table(spark, uri)
    end = F.least(F.col("offset") + F.col("tokens"), F.lit(stop if stop is not None else 1 << 62))
    begin = F.greatest("offset", F.lit(start))
    parts = shards.where(begin < end).select("path", "offset", begin.alias("b"), end.alias("e")).withColumn("at", F.explode(F.sequence(F.col("b"), F.col("e") - 1, F.lit(block))))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, offset, at, e in zip(pdf["path"], pdf["offset"], pdf["at"], pdf["e"]):
                n = min(block, e - at)
                data = np.fromfile(path, "<u4", n, offset=4 * (at - offset))
                yield pd.DataFrame({"position": np.arange(at, at + n), "token": data.astype(np.int64)})

    return parts.repartition("path", "at").mapInPandas(read, "position long, token long")


def read_positions(spark: SparkSession, uri: str, positions: DataFrame) -> DataFrame:
    """(position, token) of single positions: a range join with the shards, then each shard is mapped, not read."""
    located = locate(positions.select("position"), shard_table(spark, uri))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, part in pdf.groupby("path"):
                yield pd.DataFrame({"position": part["position"], "token": np.memmap(path, "<u4", "r")[part["place"].to_numpy()].astype(np.int64)})

    return located.repartition("path").sortWithinPartitions("path", "place").mapInPandas(read, "position long, token long")


def normal_counts(counts: dict[str, int] | None) -> dict[str, int]:
    """Counts by trimmed source, a blank one being ``unknown``; zero counts dropped."""
    out: dict[str, int] = {}
    for name, n in (counts or {}).items():
        if n:
            key = name.strip() or "unknown"
            out[key] = out.get(key, 0) + n
    return out


def source_order(index: dict, first: Sequence[str] = ()) -> dict[str, int]:
    """The rank of each source: those named ``first`` in their order, then by first appearance over all shards, by name within one."""
    names = [n.strip() or "unknown" for n in first]
    for s in index["shards"]:
        names += sorted(normal_counts(s["source_token_counts"]))
    return {n: k for k, n in enumerate(dict.fromkeys(names))}


def index_summary(spark: SparkSession, indexes: dict[str, str]) -> DataFrame:
    """(split, shards, tokens, sources, largest_shard) of the index of each split."""
    rows = []
    for split, uri in indexes.items():
        index = load_index(uri)
        sizes = [s["tokens"] for s in index["shards"]]
        rows.append((split, len(sizes), sum(sizes), len(normal_counts(index["source_token_counts"])), max(sizes, default=0)))
    return spark.createDataFrame(rows, "split string, shards long, tokens long, sources long, largest_shard long")


def shuffle_corpus(spark: SparkSession, uri: str, folder: str, chunk: int = 262_144, seed: int = 20260724, size: int | None = None, first_sources: Sequence[str] = ()) -> dict:
    """Rewrite a tokenized corpus with its chunks in the stride order; tokens are copied, never decoded.

    Only metadata is planned and shuffled: a task that writes a shard reads the pieces it needs from the old files.  A
    shard's runs lie in ``source_order``; those of a shard whose counts do not add up are one run of ``unknown``.  ``size``
    is the largest old shard by default.
    """
    index, source = load_index(uri), os.path.dirname(local_path(uri))
    os.makedirs(folder, exist_ok=True)
    runs = []
    order = source_order(index, first_sources)
    for k, s in enumerate(index["shards"]):
        counts = normal_counts(s["source_token_counts"])
        whole = counts if sum(counts.values()) == s["tokens"] else {"unknown": s["tokens"]}
        runs += [(k, f"{source}/{s['path']}", n, order.get(n, len(order)), t) for n, t in whole.items()]
    rows = spark.createDataFrame(runs, "shard long, path string, source string, rank int, tokens long")
    planned = shuffle.schedule(shuffle.chunks(rows, chunk, ["shard", "path"], ["rank", "source"]).select("shard", "path", "source", "chunk", "offset", "tokens"), seed, ["shard"])
    placed = planned.drop("tokens").join(prefix_sum(planned, ["step"], "tokens"), "step")
    size = size or max(s["tokens"] for s in index["shards"])
    pieces = shard_pieces(placed, size, "start", "tokens").select("shard", "place", F.col("source").alias("source_id"), "path", (F.col("offset") + F.col("from")).alias("at"), "taken")

    def read(row: dict) -> bytes:
        return np.fromfile(row["path"], "<u4", row["taken"], offset=4 * row["at"]).tobytes()

    return _publish(pieces, folder, read)


def listing(folder: str) -> list[str]:
    """Shard files of a folder, sorted."""
    return sorted(glob.glob(f"{folder}/tokens-*.bin"))


def package(source: str, folder: str, train_shards: int, validation_shards: int = 1, how: str = "copy", validation_source: str | None = None) -> dict[str, dict]:
    """Lay out the first ``train_shards`` shards of a folder as train, and as validation the next ``validation_shards`` of it or
    the first of a folder of their own, with an index each.

    ``how`` is copy, hardlink or symlink.  Hashes are computed anew.  Too few shards fail.
    """
    import shutil

    if min(train_shards, validation_shards) < 1:
        raise ValueError("train_shards and validation_shards must be positive")
    found = listing(source)
    rest = found[train_shards:] if validation_source is None else listing(validation_source)
    if len(found) < train_shards or len(rest) < validation_shards:
        raise IndexError_(f"{train_shards} shards of train and {validation_shards} of validation are wanted; there are {len(found)}" + ("" if validation_source is None else f" and {len(rest)}"))
    place = {"copy": shutil.copyfile, "hardlink": os.link, "symlink": os.symlink}[how]
    out = {}
    for split, files in (("train", found[:train_shards]), ("validation", rest[:validation_shards])):
        os.makedirs(f"{folder}/{split}", exist_ok=True)
        shards = []
        for k, path in enumerate(files):
            name = f"tokens-{k:06d}.bin"
            place(os.path.abspath(path), f"{folder}/{split}/{name}")
            with open(path, "rb") as f:
                shards.append({"path": name, "tokens": os.path.getsize(path) // 4, "dtype": "uint32", "byte_order": "little", "sha256": hashlib.file_digest(f, "sha256").hexdigest(), "source_token_counts": {}})
        out[split] = INDEX | {"total_tokens": sum(s["tokens"] for s in shards), "source_token_counts": {}, "shards": shards}
        write_json(f"{folder}/{split}/index.json", out[split])
    return out
