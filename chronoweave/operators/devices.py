"""Which device recorded each file, from paths and metadata alone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Strategies in the order they are asked.
STRATEGIES = ("card-structure", "directory", "filename-prefix", "container-metadata", "extension-class")


def folder_depth(folders: list[list[str]], stems: list[str]) -> int:
    """How many folder levels name the devices of a project.

    A level more counts if, in some folder, all of two or more children echo
    their names in most of their files, or two children hold a file of the
    same name.
    """
    clean = lambda s: "".join(c for c in s if c.isascii() and c.isalnum()).upper()
    deepest = max(map(len, folders), default=0)
    depth = min(1, deepest)
    while 0 < depth < deepest:
        children: dict[tuple, dict[str, list[str]]] = {}
        for parts, name in zip(folders, stems):
            if len(parts) > depth:
                children.setdefault(tuple(parts[:depth]), {}).setdefault(parts[depth], []).append(name)
        earned = False
        for own in children.values():
            if len(own) < 2:
                continue
            echo = all(clean(c) and 2 * sum(clean(n).startswith(clean(c)) for n in names) > len(names) for c, names in own.items())
            sets = [{n.lower() for n in names} for names in own.values()]
            if echo or sum(map(len, sets)) > len(set().union(*sets)):
                earned = True
                break
        if not earned:
            break
        depth += 1
    return depth


def directory_devices(files: DataFrame) -> DataFrame:
    """(project_id, clip_id, directory): the folders down to the level that names devices; null for files without one."""
    rows = files.select("project_id", "clip_id", X.segments(F.col("path")).alias("parts"))

    def name(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [list(p) for p in pdf.parts]
        folders = [p[:-1] for p in parts]
        stems = [p[-1].rsplit(".", 1)[0] if p and p[-1].rfind(".") > 0 else (p[-1] if p else "") for p in parts]
        depth = folder_depth(folders, stems)
        return pd.DataFrame({"project_id": pdf.project_id, "clip_id": pdf.clip_id, "folder": ["-".join(f[:depth]) if f else None for f in folders]})

    named = rows.groupBy("project_id").applyInPandas(name, "project_id string, clip_id string, folder string")
    return named.select("project_id", "clip_id", F.when(F.col("folder").isNotNull(), X.sanitise(F.col("folder"))).alias("directory"))


def strategy_answers(files: DataFrame) -> DataFrame:
    """The device by each strategy, null where it has no answer. Files: project_id, clip_id, path, has_video, make, model, serial."""
    path = F.col("path")
    own = files.withColumns({
        "card-structure": X.card_device(path), "filename-prefix": X.filename_device(path),
        "container-metadata": X.metadata_device(F.col("make"), F.col("model"), F.col("serial")), "extension-class": X.extension_class(path, F.col("has_video")),
    })
    return own.join(directory_devices(files), ["project_id", "clip_id"])


def attempts(answers: DataFrame) -> DataFrame:
    """For each strategy how many files it names, how many devices, and whether it could win."""
    one = [answers.select("project_id", F.lit(k).alias("ordinal"), F.lit(s).alias("basis"), F.col(f"`{s}`" if s != "directory" else "directory").alias("device")) for k, s in enumerate(STRATEGIES)]
    rows = one[0]
    for more in one[1:]:
        rows = rows.union(more)
    return rows.groupBy("project_id", "ordinal", "basis").agg(F.count("device").alias("named"), F.count("*").alias("files"), F.count_distinct("device").alias("devices"))


def group_clips(files: DataFrame) -> DataFrame:
    """(project_id, clip_id, device_id, basis).

    The first strategy but the last that names all files, and two devices at
    least, wins for the whole project. Else each file takes the first name any
    strategy gives it, if that makes two devices; else the first strategy that
    names all; else the extension's class.
    """
    answers = strategy_answers(files)
    tried = attempts(answers)
    full = F.col("named") == F.col("files")
    specific = F.col("ordinal") < len(STRATEGIES) - 1
    verdict = tried.groupBy("project_id").agg(F.min(F.when(full & specific & (F.col("devices") >= 2), F.col("ordinal"))).alias("winner"), F.min(F.when(full & specific, F.col("ordinal"))).alias("fallback"))
    columns = [F.col(f"`{s}`") for s in STRATEGIES]
    taken = F.array_position(F.transform(F.array(*[c.isNotNull() for c in columns]), lambda x: x), True) - 1
    composed = answers.withColumn("names", F.array(*columns)).withColumn("taken", taken.cast("int")).withColumn("composed", F.get("names", F.col("taken")))
    tally = composed.groupBy("project_id", "taken").agg(F.count("*").alias("n"), F.min("clip_id").alias("first"))
    mode = tally.groupBy("project_id").agg(F.max_by("taken", F.struct("n", -F.col("taken"))).alias("mode"))
    kinds = composed.groupBy("project_id").agg(F.count_distinct("composed").alias("kinds"))
    rows = composed.join(verdict, "project_id").join(mode, "project_id").join(kinds, "project_id")
    several = F.col("kinds") >= 2
    whole = F.coalesce("winner", F.when(~several, F.coalesce("fallback", F.lit(len(STRATEGIES) - 1))))
    names = F.array(*[F.lit(s) for s in STRATEGIES])
    return rows.select(
        "project_id", "clip_id", F.when(whole.isNotNull(), F.get("names", whole)).otherwise(F.col("composed")).alias("device_id"), F.get(names, F.coalesce(whole, F.col("mode"))).alias("basis")
    )


def device_order(assigned: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, device_id, ordinal): cameras before recorders, then by name."""
    kinds = assigned.join(files, ["project_id", "clip_id"]).groupBy("project_id", "device_id").agg(F.min(F.when(X.extension_class(F.col("path"), F.col("has_video")) == "AUDIO", 1).otherwise(0)).alias("audio_only"))
    order = Window.partitionBy("project_id").orderBy("audio_only", F.collate("device_id", "UNICODE"))
    return kinds.withColumn("ordinal", F.row_number().over(order)).select("project_id", "device_id", "audio_only", "ordinal")


def grouping_warnings(assigned: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, warning): stream files outside of their card, and projects of one device."""
    loose = files.where(X.is_card_stream(F.col("path"))).groupBy("project_id").agg(F.count("*").alias("n"))
    loose = loose.select("project_id", F.format_string("%d stream files lie outside of a card folder; spanned clips cannot be told", "n").alias("warning"))
    one = assigned.groupBy("project_id").agg(F.count_distinct("device_id").alias("d"), F.count("*").alias("n"), F.min("device_id").alias("device")).where("d < 2 AND n > 1")
    return loose.union(one.select("project_id", F.format_string("all %d clips are from one device (%s); two are needed", "n", "device")))


def device_of(clips: DataFrame, assigned: DataFrame, overrides: DataFrame) -> DataFrame:
    """The device of each clip: set by hand, else found, else DEVICE."""
    by_hand = overrides.select("project_id", "clip_id", F.col("device_id").alias("by_hand"))
    return clips.select("project_id", "clip_id").join(by_hand, ["project_id", "clip_id"], "left").join(assigned.select("project_id", "clip_id", "device_id"), ["project_id", "clip_id"], "left").select(
        "project_id", "clip_id", F.coalesce("by_hand", "device_id", F.lit("DEVICE")).alias("device_id")
    )
