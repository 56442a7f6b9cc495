"""Voices: clustering, learning and unlearning of prints, names and languages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import aggs, joins, windows
from .common import components, cut_lineage, first_per, small
from .similar import similar_pairs

DUPLICATE, CAP, KNOWN = 0.85, 8, 0.80


def _unit(rows: list) -> np.ndarray:
    m = np.array(rows, float)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0, 1, size)


def complete_linkage(vectors: list, threshold: float) -> list[int]:
    """Group numbers: groups merge while their worst pair clears the threshold; a group goes by its smallest member.

    By chains of nearest neighbours: each member of a chain is the nearest group to the one before it, and two that are
    each other's nearest merge. No merge brings groups nearer, so this gives the groups that merging the best pair of all
    gives, in time quadratic in the vectors. Of equally near groups the last of the chain counts, then the smallest.
    """
    u = _unit(vectors) if vectors else np.empty((0, 1))
    n = len(vectors)
    worst = u @ u.T
    worst = np.where(np.isnan(worst), -np.inf, np.minimum(worst, worst.T))
    np.fill_diagonal(worst, -np.inf)
    label, chain = np.arange(n), []
    ended = np.zeros(n, bool)
    for start in range(n):
        if not ended[start]:
            chain.append(start)
        while chain:
            tip = chain[-1]
            near = int(worst[tip].argmax())
            if worst[tip, near] < threshold:
                ended[chain.pop()] = True
            elif len(chain) > 1 and worst[tip, chain[-2]] >= worst[tip, near]:
                low, high = sorted((chain.pop(), chain.pop()))
                both = np.minimum(worst[low], worst[high])
                both[[low, high]] = -np.inf
                worst[low] = worst[:, low] = both
                worst[high] = worst[:, high] = -np.inf
                label[label == high] = low
                ended[high] = True
                # The merged group may have partners left.
                if not chain:
                    chain.append(low)
            else:
                chain.append(near)
    return label.tolist()


#: Vectors of a connected group that one task links by itself.
ONE_TASK = 1000


def cluster_voices(vectors: DataFrame, threshold: float = 0.65, one_task: int = ONE_TASK) -> DataFrame:
    """(session_id, item, label): complete linkage per meeting; the label is the group's smallest item.

    vectors: session_id, item (long), centroid. A merge needs every cross pair at the threshold, so no merge leaves a
    connected component of the pairs at the threshold: pairs are found first, small components are linked in a task each,
    and larger ones in rounds over the table of their pairs.
    """
    pairs = cut_lineage(similar_pairs(vectors.select(F.col("session_id").alias("group"), F.col("item").alias("key"), F.col("centroid").alias("vector")), None, threshold).withColumnRenamed("group", "session_id"))
    node = lambda c: F.struct("session_id", F.col(c).alias("item"))
    roots = components(pairs.select(node("a").alias("a"), node("b").alias("b"))).select(F.col("node.session_id").alias("session_id"), F.col("node.item").alias("item"), F.col("root.item").alias("_root"))
    sizes = roots.groupBy("session_id", "_root").agg((F.count("*") > one_task).alias("_large"))
    held = vectors.join(roots.join(sizes, ["session_id", "_root"]), ["session_id", "item"], "left")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("item")
        items = group["item"].tolist()
        return pd.DataFrame({"session_id": group["session_id"], "item": items, "label": [items[k] for k in complete_linkage(group["centroid"].tolist(), threshold)]})

    alone = held.where("_root IS NULL").select("session_id", "item", F.col("item").alias("label"))
    linked = held.where("NOT _large").groupBy("session_id", "_root").applyInPandas(lambda g: link(g), "session_id long, item long, label long")
    large = cut_lineage(held.where("_large").select("session_id", "item"))
    if large.isEmpty():
        return alone.union(linked)
    mine = large.withColumnRenamed("item", "a")
    return alone.union(linked).union(linked_in_rounds(large, pairs.join(mine, ["session_id", "a"], "left_semi")))


def linked_in_rounds(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(session_id, item, label) by complete linkage of items (session_id, item) over their pairs (session_id, a, b, score)
    at the threshold.

    In a round each group looks for its nearest one, and two that are each other's nearest merge; no merge brings groups
    nearer, so all of these merges are among those that merging the best pair of all would come to. The table of pairs of
    groups then has the worst score of each two and how many pairs are behind it: where one is missing they can not merge.
    Of equally near pairs the one of smaller labels counts as nearer.
    """
    label = items.withColumn("label", F.col("item")).withColumn("n", F.lit(1).cast("long"))
    table = pairs.select("session_id", "a", "b", "score", F.lit(1).cast("long").alias("pairs"))
    groups = label.select("session_id", F.col("label").alias("g"), "n")
    while True:
        near = F.struct("score", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))
        both = table.select("session_id", F.col("a").alias("g"), near.alias("near")).unionByName(table.select("session_id", F.col("b").alias("g"), near.alias("near")))
        best = both.groupBy("session_id", "g").agg(F.max("near").alias("near"))
        # A pair that is the best of both its groups.
        merged = cut_lineage(best.groupBy("session_id", "near").agg(F.count("*").alias("k")).where("k = 2").select("session_id", (-F.col("near.a")).alias("into"), (-F.col("near.b")).alias("g")))
        if merged.isEmpty():
            return label.select("session_id", "item", "label")
        to = lambda df, c: df.join(merged.withColumnRenamed("g", c), ["session_id", c], "left").withColumn(c, F.coalesce("into", c)).drop("into")  # noqa: E731, B023
        label = cut_lineage(to(label, "label"))
        groups = cut_lineage(to(groups, "g").groupBy("session_id", "g").agg(F.sum("n").alias("n")))
        moved = to(to(table, "a"), "b").where("a <> b")
        worst = moved.groupBy("session_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("score").alias("score"), F.sum("pairs").alias("pairs"))
        size = lambda c: groups.select("session_id", F.col("g").alias(c), F.col("n").alias(f"n_{c}"))  # noqa: E731, B023
        table = cut_lineage(worst.join(size("a"), ["session_id", "a"]).join(size("b"), ["session_id", "b"]).where("pairs = n_a * n_b").select("session_id", "a", "b", "score", "pairs"))


def regroup_labels(turns: DataFrame, vectors: DataFrame, threshold: float = 0.75, pooled: float = 60.0, least: float = 5.0) -> DataFrame:
    """Turns with labels of one voice made one: up to ``pooled`` seconds of a label's longest turns are averaged and
    clustered; then strays are absorbed and neighbours healed. vectors: session_id, turn_id, embedding."""
    span = F.col("end_time") - F.col("start")
    w = Window.partitionBy("session_id", "speaker").orderBy(F.desc("_s"), "turn_id")
    before = F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    picked = cut_lineage(turns.withColumn("_s", span).withColumn("_before", before).where(F.col("_before") < pooled).select("session_id", "turn_id", "speaker", "_s"))
    # A few turns of a label are picked, one row of a label is pooled: kept, since the rounds read them again.
    pool = cut_lineage(aggs.centroids(vectors.join(small(picked), ["session_id", "turn_id"]).select("session_id", "speaker", F.col("_s").alias("seconds"), "embedding"), least, 0.0))
    groups = cluster_voices(pool.select("session_id", F.col("speaker").cast("long").alias("item"), "centroid"), threshold)
    named = turns.join(groups.select("session_id", F.col("item").alias("_i"), "label"), (turns["session_id"] == groups["session_id"]) & (turns["speaker"].cast("long") == F.col("_i")), "left").drop(groups["session_id"])
    named = named.withColumn("speaker", F.coalesce(F.col("label").cast("int"), F.col("speaker"))).drop("_i", "label")
    return windows.heal_turns(windows.absorb_strays(named, least))


def _remember(held: list[np.ndarray], vector: np.ndarray, duplicate: float, cap: int) -> list[np.ndarray]:
    if held:
        near = (_unit(held) @ _unit([vector])[0]).tolist()
        if max(near) >= duplicate:
            return held
        if len(held) >= cap:
            drop = max(range(len(held)), key=lambda k: (near[k], k))
            held = held[:drop] + held[drop + 1 :]
    return [*held, vector]


def remember_voices(events: DataFrame, duplicate: float = DUPLICATE, cap: int = CAP) -> DataFrame:
    """(name, place, centroid): the prints kept per name after the events (seq, name, centroid) in order.

    A print close to a kept one teaches nothing; at the cap the kept one closest to the new goes first.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        held: list[np.ndarray] = []
        for e in group.sort_values("seq").itertuples():
            held = _remember(held, np.asarray(e.centroid, np.float32), duplicate, cap)
        return pd.DataFrame({"name": group["name"].iloc[0], "place": range(len(held)), "centroid": [v.tolist() for v in held]})

    return events.select("seq", "name", "centroid").groupBy("name").applyInPandas(fold, "name string, place int, centroid array<float>")


def unlearn_voice(prints: DataFrame, wrong: DataFrame, least: float = KNOWN) -> DataFrame:
    """prints (print_id, name, centroid) without, for each row of wrong (name, vector), the closest variant if close enough."""
    w = wrong.select("name", F.col("vector").alias("_v"), F.xxhash64("name", "vector").alias("_w"))
    scored = prints.join(w, "name").withColumn("_s", T.cosine(F.col("centroid"), F.col("_v"))).where(F.col("_s") >= least)
    return prints.join(first_per(scored, ["name", "_w"], F.desc("_s"), F.desc("print_id")).select("print_id").distinct(), "print_id", "left_anti")


def auto_learn(matches: DataFrame, least: float = DUPLICATE) -> DataFrame:
    """The matches (seq, name, score, centroid) sure enough to learn from."""
    return matches.where(F.col("score") >= least)


def suggest_names(prints: DataFrame, known: DataFrame, named: DataFrame, unnamed: DataFrame, floor: float = 0.45, close: float = 0.05, min_lines: int = 25, fillers: tuple[str, ...] = aggs.FILLERS) -> DataFrame:
    """(session_id, code, name, score, second, how): a name for codes without one.

    The best voice at the floor; if the second is within ``close``, the wording of the code's lines chooses between the
    two where there are enough lines, else it is unsure. named: named lines; unnamed: session_id, code, text.
    """
    w = Window.partitionBy("session_id", "code").orderBy(F.desc(F.round("score", 9)), "name")
    ranked = joins.voice_scores(prints, known, floor - close - 1e-9).withColumn("_n", F.row_number().over(w))
    two = ranked.where("_n <= 2").groupBy("session_id", "code").agg(
        F.max(F.when(F.col("_n") == 1, F.col("name"))).alias("name"), F.max(F.when(F.col("_n") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("_n") == 2, F.col("name"))).alias("second"), F.max(F.when(F.col("_n") == 2, F.col("score"))).alias("_s2")
    ).where(F.col("score") >= floor)
    tight = F.col("second").isNotNull() & (F.col("score") - F.col("_s2") < close)
    key = F.concat_ws(":", "session_id", "code")
    n = unnamed.groupBy("session_id", "code").agg(F.count("*").alias("_lines"))
    asked = two.where(tight).join(n, ["session_id", "code"]).where(F.col("_lines") >= min_lines).withColumn("test_id", key)
    tests = unnamed.withColumn("test_id", key).join(asked.select("test_id"), "test_id", "left_semi").select("test_id", "session_id", "text")
    places = aggs.rank_wording(aggs.wording_profile(named, fillers), tests, fillers)
    duel = places.join(asked.select("test_id", "session_id", "code", F.col("name").alias("_a"), F.col("second").alias("_b")), "test_id").where("name = _a OR name = _b")
    won = duel.groupBy("session_id", "code").agg(F.min_by("name", "place").alias("_won"), F.count("*").alias("_of")).where("_of = 2")
    out = two.join(won, ["session_id", "code"], "left")
    how = F.when(~F.coalesce(tight, F.lit(False)), "voice").when(F.col("_won").isNotNull(), "wording").otherwise("unsure")
    return out.withColumn("how", how).select("session_id", "code", F.coalesce("_won", "name").alias("name"), "score", F.when(F.col("how") == "unsure", F.col("second")).alias("second"), "how")


def forced_languages(codes: DataFrame, names: DataFrame, known: DataFrame, pinned: DataFrame) -> DataFrame:
    """(session_id, code, lang): the pinned language, else that of the recognised name, else the one learned (codes.lang)."""
    n = names.select("session_id", "code", "name").join(known.select("name", F.col("language").alias("_known")).distinct(), "name", "left").select("session_id", "code", "_known")
    out = codes.join(n, ["session_id", "code"], "left").join(pinned.select("session_id", "code", F.col("lang").alias("_pin")), ["session_id", "code"], "left")
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    return out.select("session_id", "code", F.coalesce(filled("_pin"), filled("_known"), filled("lang")).alias("lang"))


def derived_prints(utts: DataFrame, n: int = 5) -> DataFrame:
    """(session_id, code, centroid): the mean over each speaker's sample utterances. utts: with embedding."""
    picked = windows.voiceprint_samples(utts, n)
    return aggs.centroids(picked.select("session_id", "speaker", (F.col("end_time") - F.col("start")).alias("seconds"), "embedding"), 0.0).select("session_id", F.col("speaker").alias("code"), "centroid")


def refresh_prints(changed: DataFrame, old: DataFrame, utts: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prints after, unlearn: name and vector, learn: name and vector) for the changed codes (session_id, code).

    A code without lines loses its print; another gets one derived anew. What its name had learned from the old print
    is to be unlearned, and the new one learned.
    """
    key = ["session_id", "code"]
    codes = changed.select(*key).distinct()
    new = derived_prints(utts.join(codes.withColumnRenamed("code", "speaker"), ["session_id", "speaker"], "left_semi"))
    after = old.join(codes, key, "left_anti").select(*key, "centroid").unionByName(new)
    named = names.where(F.trim("name") != "").select(*key, "name")
    gone = old.join(codes, key, "left_semi").join(named, key).select("name", F.col("centroid").alias("vector"))
    return after, gone, new.join(named, key).select("name", F.col("centroid").alias("vector"))


def name_speakers(events: DataFrame, names: DataFrame, prints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names after, unlearn, learn) for naming events (seq, session_id, code, name): the last of each code counts.

    A changed name unlearns the code's print under the old name; a name that is not blank learns it.
    """
    key = ["session_id", "code"]
    last = first_per(events, key, F.desc("seq")).select(*key, F.trim("name").alias("name"))
    was = names.select(*key, F.col("name").alias("_old"))
    both = last.join(was, key, "left").join(prints.select(*key, "centroid"), key, "left")
    after = names.join(last, key, "left_anti").select(*key, "name").unionByName(last.where("name <> ''"))
    gone = both.where("_old IS NOT NULL AND _old <> name AND _old <> '' AND centroid IS NOT NULL").select(F.col("_old").alias("name"), F.col("centroid").alias("vector"))
    return after, gone, both.where("name <> '' AND centroid IS NOT NULL").select("name", F.col("centroid").alias("vector"))


def harvest(sessions: DataFrame, names: DataFrame, known: DataFrame, lines: DataFrame, clips: DataFrame, n: int = 8) -> DataFrame:
    """(name, session_id): clips to keep of meetings about to go: named, still known voices with a sample, n per name."""
    doomed = names.join(sessions.select("session_id"), "session_id", "left_semi").join(known.select("name").distinct(), "name", "left_semi")
    shown = doomed.join(windows.speaker_samples(lines).select("session_id", F.col("speaker").alias("code")), ["session_id", "code"], "left_semi")
    return aggs.clip_cap(clips.select("name", "session_id").union(shown.select("name", "session_id")).distinct(), n)


