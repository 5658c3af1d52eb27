"""Records of runs as others see them: failure details, ids, identities, locations, phases, turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import first_text, looks_like_traceback, redact
from weftline.operators.prefix import ordinals


def failure_detail(failure_type: Column, message: Column, detail: Column, error: Column, known: tuple[str, ...]) -> Column:
    """The first of three texts that is not blank, after the failure's type unless that is blank or ``known``; the type alone
    where there is no text."""
    kind = F.trim(F.coalesce(failure_type, F.lit("")))
    text = first_text(message, detail, error)
    return F.when(text.isNull(), kind).when((kind != "") & ~kind.isin(*known), F.concat_ws(": ", kind, text)).otherwise(text)


def shown_detail(reason: Column, detail: Column, shown: tuple[str, ...]) -> Column:
    """A detail as it may be shown: redacted, and only for reasons that are shown or a log's tail that tells of the worker's own
    failure; empty otherwise."""
    return F.when(F.coalesce(reason.isin(*shown), F.lit(False)) | looks_like_traceback(detail), redact(detail)).otherwise("")


def parts_text(**parts: Column) -> Column:
    """``name=value`` of the parts that are not blank, joined by semicolons."""
    return F.concat_ws("; ", *[F.when(F.trim(v) != "", F.concat(F.lit(f"{k}="), v)) for k, v in parts.items()])


def stored_or_computed(stored: dict[str, Column], computed: dict[str, Column]) -> dict[str, Column]:
    """Each metric as stored, or computed where it was not."""
    return {k: F.coalesce(stored[k], computed[k]) for k in computed}


def final_loss(losses: Column, supplied: Column, tolerance: float = 1e-12) -> Column:
    """The last loss; a supplied one that differs by more than the tolerance gives null."""
    last = F.try_element_at(losses, F.lit(-1))
    return F.when(supplied.isNull() | (F.abs(supplied - last) <= tolerance), last)


def run_number(prefix: str, n: Column, digits: int = 6) -> Column:
    """An id like exp-000001."""
    return F.format_string(f"{prefix}-%0{digits}d", n)


def worker_identity(experiment: Column, final: Column) -> Column:
    """The run a worker speaks for: its experiment unless that is blank, else its final run."""
    return first_text(experiment, final)


def runtime_limit(manifest: Column, config: Column, reserved: Column) -> Column:
    """The manifest's limit, or else the configuration's, or else what is reserved; one that is not positive fails."""
    limit = F.coalesce(manifest, config, reserved)
    return F.when(limit > 0, limit).otherwise(F.raise_error(F.lit("a runtime limit must be positive")).cast("long"))


def location(local: Column, path: Column, name: Column, options: Column, parts: Column, part: Column) -> Column:
    """Where rows of a source come from, as one text that changes when they might: a local path, or else the data set with
    its loader options (JSON values by name, in the order given), and the part of several."""
    remote = F.concat(path, F.coalesce(F.concat(F.lit(":"), name), F.lit("")))
    loader = F.array_join(F.transform(F.filter(F.map_entries(options), lambda e: e["value"].isNotNull()), lambda e: F.concat_ws("=", e["key"], e["value"])), "&")
    base = F.coalesce(F.when(F.trim(local) != "", local), F.when(F.coalesce(loader, F.lit("")) != "", F.concat_ws("?", remote, loader)).otherwise(remote))
    return F.when(parts > 1, F.concat(base, F.lit("#download_shard="), part.cast("string"), F.lit("/"), parts.cast("string"))).otherwise(base)


def phase(kind: Column, final: Column, terminal: tuple[str, ...]) -> Column:
    """How far the events of a run brought it: ended, running or submitted. A loss shows that an experiment runs, a final run
    only its worker's start."""
    running = (kind == "worker_started") | (kind == "validation") & ~final
    return F.when(F.bool_or(kind.isin(*terminal)), "ended").when(F.bool_or(running), "running").otherwise("submitted")


def chunks(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """(*order, chunk): rows in runs of ``size`` by ``order``, across the borders of files."""
    return ordinals(rows, order).select(*order, F.floor(F.col("ordinal") / size).alias("chunk"))


def turns(tasks: DataFrame, source: str, part: str, active: int) -> DataFrame:
    """``tasks`` with turn: ``active`` sources at a time, in their order; their first parts, then their second ones, and so on."""
    names = tasks.select(source).distinct()
    ranked = tasks.join(names.join(ordinals(names, [source], "_rank"), source), source).withColumn("_group", F.floor(F.col("_rank") / active))
    turn = ordinals(ranked, ["_group", part, "_rank"], "turn")
    return ranked.join(turn, ["_group", part, "_rank"]).select(*tasks.columns, "turn")


def without_keys(payload: Column, private: tuple[str, ...]) -> Column:
    """A map without its private keys."""
    return F.map_filter(payload, lambda k, _: ~k.isin(*private))


def first_few(rows: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """(*by, shown, more): the first values of ``order`` of each group, as a message lists them, and how many there are besides."""
    from pyspark.sql import Window

    kept = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_nth") <= most)
    shown = kept.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_nth", order))), lambda x: x[order].cast("string")), ", ").alias("shown"))
    return shown.join(rows.groupBy(*by).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more")), by)
