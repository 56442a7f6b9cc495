"""Correction of lines by glossary and learned pairs, and what edits teach."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from importlib.util import find_spec
from itertools import accumulate, product

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import correction as C
from ..functions import text as T
from .common import components, cut_lineage, small
from .occurrences import SLICE_CHARS, SLICE_TERMS, occurrences

PARTS = ("aliases", "sound", "spelling")


def reading_table(readings: DataFrame | None, column: str) -> dict[int, str]:
    return {} if readings is None else {ord(c): r for c, r in readings.select("char", column).collect()}


def reader(readings: DataFrame | None, column: str) -> Callable[[Column], Column]:
    """text -> its reading, a character at a time; characters without one stay. There is a row for each character at most,
    so the list is bounded by the characters there are."""
    if readings is None:
        return lambda text: text
    table = reading_table(readings, column)

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t.translate(table), na_action="ignore")

    return read


def near_terms(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """(token, term) of tokens (token) within ``most`` edits of a rule's key, case apart.

    Of most + 1 pieces that a token is cut into, one survives any ``most`` edits, moved by as many places at most. So
    tokens wait at their pieces, keys come with every substring that may be such a piece, and pairs that meet are
    measured. Rows grow with tokens times pieces and keys times places, never with tokens times keys.
    """
    words = tokens.where(F.col("token").isNotNull()).select("token", F.lower("token").alias("low")).distinct()
    keys = rules.select("term", "key", "most").distinct()
    same = words.join(keys, F.col("low") == F.col("key")).select("token", "term")
    piece = lambda i, n, e: (F.floor(i * n / (e + 1)).cast("int"), (F.floor((i + 1) * n / (e + 1)) - F.floor(i * n / (e + 1))).cast("int"))
    fuzzy = keys.where("most > 0").withColumn("size", F.length("key"))
    every = fuzzy.withColumn("n", F.explode(F.sequence(F.greatest(F.lit(1), F.col("size") - F.col("most")), F.col("size") + F.col("most")))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("most"))))
    at, length = piece(F.col("i"), F.col("n"), F.col("most"))
    moved = F.col("size") - F.col("n")
    shifts = F.sequence(F.ceil((moved - F.col("most")) / 2).cast("int"), F.floor((moved + F.col("most")) / 2).cast("int"))
    places = every.withColumn("length", length).withColumn("place", F.explode(F.transform(shifts, lambda k: at + k))).where("length > 0 AND place >= 0 AND place + length <= size")
    waiting = places.select("term", "key", "most", "n", "i", F.substring("key", F.col("place") + 1, F.col("length")).alias("piece")).distinct()
    # The lengths and budgets that keys ask for: a few rows.
    asked = waiting.select("n", "most").distinct()
    cut = words.withColumn("n", F.length("low")).join(asked, "n").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("most"))))
    at, length = piece(F.col("i"), F.col("n"), F.col("most"))
    pieces = cut.select("token", "low", "n", "most", "i", F.substring("low", at + 1, length).alias("piece"))
    met = pieces.join(waiting, ["n", "most", "i", "piece"]).select("token", "low", "term", "key", "most").distinct()
    # Levenshtein with a bound gives -1 beyond it.
    close = met.where(F.levenshtein("low", "key") <= F.col("most")).select("token", "term")
    return same.unionByName(close).distinct()


def _windows(text: Column, width: Column) -> Column:
    n = F.length(text) - width + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, width)))).otherwise(F.array().cast("array<string>"))


def _sounding(keys: dict[str, list[int]], table: dict[int, str]):
    """Rows (text); gives (piece, width): windows that read as one of the keys, of a width of its terms, once a batch. An
    automaton goes over the reading of the whole text; a match counts where it begins and ends with a character."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ahocorasick import Automaton

        tree = Automaton()
        for k in keys:
            tree.add_word(k, k)
        tree.make_automaton()
        single = all(len(r or "") == 1 for r in table.values())
        for b in batches:
            found = set()
            for text in b.column(0).to_pylist():
                read = text.translate(table)
                # The characters that begin at each place of the reading.
                at = defaultdict(list)
                for k, offset in enumerate(() if single else accumulate((len(table.get(ord(c), c) or "") for c in text), initial=0)):
                    at[offset].append(k)
                for last, key in tree.iter(read):
                    start, end = last + 1 - len(key), last + 1
                    for i, j in ((start, end),) if single else product(at.get(start, ()), at.get(end, ())):
                        if j - i in keys[key]:
                            found.add((text[i:j], j - i))
            pieces = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pieces], pa.string()), pa.array([w for _, w in pieces], pa.int32())], ["piece", "width"])

    return rows


class Rules:
    """The lists people keep, as tables that pieces of text meet: what a window of letters sounds like, and what a Latin word
    is spelled like. Nothing bounds their number."""

    def __init__(self, terms: DataFrame, readings: DataFrame | None = None, letters: str = T.HAN, parts: tuple[str, ...] = PARTS) -> None:
        self.toneless, self.toned, self.letters, self.parts = reader(readings, "toneless"), reader(readings, "toned"), letters, parts
        self.known = terms.select(F.col("source").alias("piece")).distinct()
        rules = term_rules(terms, self.toneless(F.col("source")), letters).select("term", "key", "by_sound", "most").distinct()
        self.sounds = rules.where("by_sound").select("term", "key", F.length("term").alias("width"))
        self.spellings = rules.where("NOT by_sound")
        #: Lengths of terms: a few numbers.
        self.widths = [r[0] for r in self.sounds.select("width").distinct().collect()] if "sound" in parts else []
        self.table = reading_table(readings, "toneless") if self.widths else {}

    def said(self, texts: DataFrame) -> DataFrame:
        """(piece, width): windows of texts (text) that may sound as a term. Keys in bounds go over the texts as an automaton;
        if there are more, all windows of the letters meet them."""
        keys = self.sounds.select("key", "width").distinct()
        n, chars = keys.agg(F.count("*"), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
        if find_spec("ahocorasick") and n <= SLICE_TERMS and chars <= SLICE_CHARS:
            own = defaultdict(list)
            for key, width in keys.collect():
                own[key].append(width)
            return texts.select("text").mapInArrow(_sounding(dict(own), self.table), "piece string, width int")
        width = F.explode(F.array(*(F.lit(w) for w in self.widths))).alias("width")
        return texts.select("text", width).select(F.explode(_windows(F.col("text"), F.col("width"))).alias("piece"), "width")

    def facts(self, texts: DataFrame) -> DataFrame:
        """(piece, term, by_sound): what the rules make of the pieces of all texts (text). Each distinct piece meets the
        rules once, whatever texts it is in."""
        out = None
        if self.widths:
            # A known word is never a mistake.
            heard = self.said(texts).where(F.col("piece").rlike(f"^(?:{self.letters})+$")).select("piece", "width").distinct().join(self.known, "piece", "left_anti").withColumn("sound", self.toneless(F.col("piece")))
            rivals = heard.join(self.sounds.withColumnRenamed("key", "sound"), ["width", "sound"])
            far = F.levenshtein(self.toned(F.col("term")), self.toned(F.col("piece")))
            best = rivals.groupBy("piece").agg(F.min(F.struct(far.alias("far"), "term")).alias("best"))
            out = best.select("piece", "best.term", F.lit(True).alias("by_sound"))
        if "spelling" in self.parts:
            said = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(LATIN), F.lit(0)))).alias("token"))
            near = near_terms(said, self.spellings).where("token <> term")
            own = near.select(F.col("token").alias("piece"), "term", F.lit(False).alias("by_sound"))
            out = own if out is None else out.unionByName(own)
        return out

    def moves(self, texts: DataFrame) -> DataFrame:
        """(text, moves): the facts whose pieces a text of texts (text) holds, for texts that hold some. A piece may be part
        of a longer word, which the rewriting leaves alone."""
        facts = cut_lineage(self.facts(texts))
        held = occurrences(texts, facts.select(F.col("piece").alias("term"))).withColumnRenamed("term", "piece").join(small(facts, FACTS), "piece")
        return held.groupBy("text").agg(F.collect_set(F.struct("piece", "term", "by_sound")).alias("moves"))


#: What counts as one Latin word (fixed pattern), for Spark's expressions.
LATIN = r"[A-Za-z\x{c0}-\x{1ef9}][A-Za-z\x{c0}-\x{1ef9}'\u2019-]*"


#: Facts, or texts that ask again, that go to every task.
FACTS = 50_000


def _rewritten(text: Column, moves: Column, reach: int) -> Column:
    @F.pandas_udf("struct<fixed:string,made:array<string>>")
    def run(texts: pd.Series, moves: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([C.rewritten(t, [(m["piece"], m["term"], m["by_sound"]) for m in own], reach) for t, own in zip(texts, moves, strict=True)], columns=["fixed", "made"])

    return run(text, moves)


def aliased(texts: DataFrame, corrections: DataFrame, known: DataFrame) -> DataFrame:
    """(text, fixed) of texts (text) that hold a learned pair's wrong side: one pass, the longest side first at each place,
    and what is written is not read again. A word that the glossary knows is never a wrong side."""
    pairs = corrections.select("wrong", "right").where("wrong <> ''").join(known.select(F.col("piece").alias("wrong")), "wrong", "left_anti").groupBy("wrong").agg(F.max("right").alias("right"))
    hits = occurrences(texts, pairs.select(F.col("wrong").alias("term"))).join(pairs.withColumnRenamed("wrong", "term"), "term")
    own = hits.groupBy("text").agg(F.collect_list(F.struct("term", "right")).alias("pairs"))

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, pairs: pd.Series) -> pd.Series:
        out = []
        for text, some in zip(texts, pairs, strict=True):
            right = {p["term"]: p["right"] for p in some}
            pattern = "|".join(re.escape(w) for w in sorted(right, key=len, reverse=True))
            out.append(re.sub(pattern, lambda m, right=right: right[m[0]], text))
        return pd.Series(out)

    return own.select("text", replaced(F.col("text"), F.col("pairs")).alias("fixed"))


def corrected(lines: DataFrame, terms: DataFrame, corrections: DataFrame | None = None, readings: DataFrame | None = None, letters: str = T.HAN, parts: tuple[str, ...] = PARTS, text_col: str = "source") -> DataFrame:
    """lines with ``fixed``: the text after learned pairs, then each term's rule, longest term first, then by name; every
    rule reads what the ones before wrote.

    Tables say which pieces of a text the rules would change, and only texts with such pieces are rewritten, by those
    rules alone. A rewriting tells the places that it wrote, as far as a piece can reach around them; their pieces meet the
    rules again, and where they ask for a rule that was left out the text is rewritten anew with it. When no text asks any
    more, every text is what all rules together make of it. Equal texts are rewritten once; null and empty ones stay.
    """
    text = F.col(f"`{text_col}`")
    rules = Rules(terms, readings, letters, parts)
    base = lines.where(text != "").select(text.alias("text")).distinct()
    if corrections is not None and "aliases" in parts:
        base = base.join(aliased(base, corrections, rules.known), "text", "left").withColumn("now", F.coalesce("fixed", "text")).select("text", "now")
    else:
        base = base.withColumn("now", F.col("text"))
    base = cut_lineage(base)
    done = base.where("text <> now").select("text", F.col("now").alias("fixed"))
    if "sound" in parts or "spelling" in parts:
        ruled = _ruled(base.select(F.col("now").alias("key")).distinct(), rules)
        done = base.join(ruled, base["now"] == ruled["key"], "left").select("text", F.coalesce("fixed", "now").alias("fixed"))
    return lines.join(done.withColumnRenamed("text", "_text"), text == F.col("_text"), "left").withColumn("fixed", F.coalesce("fixed", text)).drop("_text")


def _ruled(texts: DataFrame, rules: Rules) -> DataFrame:
    """(key, fixed) of the texts (key) that a rule changes. Rounds deal in places by the number of their text; no piece
    carries its whole text along."""
    state = rules.moves(texts.select(F.col("key").alias("text"))).withColumnRenamed("text", "key")
    reach, done = max(rules.widths, default=1) - 1, []
    while True:
        ran = state.select("key", "moves", _rewritten(F.col("key"), F.col("moves"), reach).alias("r"))
        ran = cut_lineage(ran.select(F.monotonically_increasing_id().alias("id"), "key", "moves", "r.*"))
        made = ran.select("id", F.explode("made").alias("text"))
        asks = made.join(rules.moves(made.select("text").distinct()), "text").select("id", F.explode("moves").alias("move")).groupBy("id").agg(F.collect_set("move").alias("more"))
        asks = asks.join(ran.select("id", "moves"), "id").select("id", F.array_except("more", "moves").alias("more")).where("size(more) > 0")
        asks = small(cut_lineage(asks), FACTS)
        done.append(ran.join(asks.select("id"), "id", "left_anti").select("key", "fixed"))
        if asks.isEmpty():
            break
        state = ran.join(asks, "id").select("key", F.concat("moves", "more").alias("moves"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def term_rules(terms: DataFrame, key: Column | None = None, letters: str = T.HAN) -> DataFrame:
    """(id, term, key, by_sound, most): what each term matches and by how many edits; protected and short ones have none.

    key is the toneless reading for terms with letters of the class; without one the term itself is used.
    """
    by_sound = F.col("source").rlike(letters)
    k = F.when(by_sound, F.col("source") if key is None else key).otherwise(F.lower("source"))
    most = F.when(by_sound | (F.length(k) < 6), 0).otherwise(F.floor(F.length(k) * 0.25).cast("int"))
    rules = terms.where("mode <> 'protect'").select("id", F.col("source").alias("term"), k.alias("key"), by_sound.alias("by_sound"), most.alias("most"))
    return rules.where(F.length("key") >= 4)


def fix_latin(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Lines with ``fixed``: each Latin token that a rule reaches becomes its term, the longest term first.

    Distinct tokens meet the rules, so a word is compared once however often it is said.
    """
    pieces = lines.select("line_id", F.regexp_extract_all(F.col("source"), F.lit(LATIN), F.lit(0)).alias("_t"), F.split("source", LATIN, -1).alias("_g"))
    each = pieces.select("line_id", F.posexplode("_t").alias("_i", "token"))
    words = each.select("token").distinct()
    best = near_terms(words, rules.where("NOT by_sound")).groupBy("token").agg(F.min(F.struct((-F.length("term")).alias("n"), "term")).alias("best")).select("token", "best.term")
    new = each.join(best, "token", "left").groupBy("line_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", F.coalesce("term", "token").alias("t")))), lambda x: x["t"]).alias("_n"))
    glued = F.array_join(F.flatten(F.zip_with("_g", F.coalesce("_n", F.array().cast("array<string>")), lambda g, t: F.filter(F.array(g, t), lambda x: x.isNotNull()))), "")
    done = pieces.join(new, "line_id", "left").select("line_id", glued.alias("fixed"))
    return lines.join(done, "line_id")


def term_collisions(term: str, lines: DataFrame, known: DataFrame, key_of, letters: str = T.HAN) -> DataFrame:
    """(window, n): other spellings in the lines that sound like the term, counted with overlap. key_of: text -> toneless reading."""
    width = len(term)
    at = F.when(F.length("source") >= width, F.sequence(F.lit(1), F.length("source") - width + 1)).otherwise(F.array().cast("array<int>"))
    windows = lines.select(F.explode(F.transform(at, lambda i: F.substring(F.col("source"), i, F.lit(width)))).alias("window"))
    counted = windows.where(F.col("window").rlike(f"^(?:{letters}){{{width}}}$") & (F.col("window") != term)).groupBy("window").agg(F.count("*").alias("n"))
    return counted.join(known.select(F.col("source").alias("window")).distinct(), "window", "left_anti").where(key_of(F.col("window")) == key_of(F.lit(term)))


def diff_terms(before: Column, after: Column, letters: str = "[一-鿿]", script: tuple[str, str] = ("", "")) -> Column:
    """array<struct<wrong, right>> of the words that an edit changed."""

    @F.pandas_udf("array<struct<wrong:string,right:string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"wrong": w, "right": r} for w, r in C.changed_terms(x or "", y or "", letters, script)] for x, y in zip(a, b, strict=True)])

    return run(before, after)


def learn_corrections(events: DataFrame) -> DataFrame:
    """(wrong, right, lang, count) after the events (seq, wrong, right, lang) in order.

    A pair that inverts a stored one deletes that and is not stored; else it is stored, or its count grows. Only pairs
    that share words act on each other, so each connected group of words is folded by itself.
    """
    trimmed = events.select("seq", F.trim("wrong").alias("wrong"), F.trim("right").alias("right"), "lang").where("wrong <> '' AND right <> '' AND wrong <> right")
    roots = components(trimmed.select(F.col("wrong").alias("a"), F.col("right").alias("b")))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, list] = {}
        for e in group.sort_values("seq").itertuples():
            back = held.get(e.right)
            if back and back[0] == e.wrong:
                del held[e.right]
            elif e.wrong in held:
                held[e.wrong][0] = e.right
                held[e.wrong][2] += 1
            else:
                held[e.wrong] = [e.right, e.lang, 1]
        return pd.DataFrame([(w, r, lang, n) for w, (r, lang, n) in held.items()], columns=["wrong", "right", "lang", "count"])

    return trimmed.join(roots.withColumnRenamed("node", "wrong"), "wrong").groupBy("root").applyInPandas(fold, "wrong string, right string, lang string, count int")


def mine_terms(rejected: DataFrame, terms: DataFrame, key_of, min_count: int = 2, max_sound: float = 0.45, letters: str = "[一-鿿]", script: tuple[str, str] = ("", "")) -> DataFrame:
    """(wrong, right, n, distance, reachable): what refused corrections (original, candidate) keep asking for, nearest first."""
    pieces = rejected.select(F.explode(diff_terms(F.col("original"), F.col("candidate"), letters, script)).alias("d")).select("d.wrong", "d.right")
    java = letters.replace("一", r"\x{4e00}").replace("鿿", r"\x{9fff}")
    counted = pieces.where(F.col("right").rlike(java)).join(terms.select(F.col("source").alias("right")).distinct(), "right", "left_anti").groupBy("wrong", "right").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    a, b = key_of(F.col("wrong")), key_of(F.col("right"))
    far = F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return counted.withColumn("distance", F.round(far, 6)).withColumn("reachable", a == b).where(F.col("distance") <= max_sound).orderBy("distance", "wrong", "right")


def score_changes(pairs: DataFrame, vocabulary: DataFrame, established: int = 3, letters: str = "[一-鿿]", script: tuple[str, str] = ("", "")) -> DataFrame:
    """(class, was, now, n) of the words that pairs (before, after) change: suspect where the corpus knows the old word."""
    d = pairs.where(F.col("before") != F.col("after")).select(F.explode(diff_terms(F.col("before"), F.col("after"), letters, script)).alias("d"))
    known = vocabulary.select(F.col("gram").alias("was"), F.col("n").alias("_seen"))
    joined = d.select(F.col("d.wrong").alias("was"), F.col("d.right").alias("now")).join(known, "was", "left")
    kind = F.when(F.coalesce("_seen", F.lit(0)) >= established, "suspect").otherwise("fix")
    return joined.groupBy(kind.alias("class"), "was", "now").agg(F.count("*").alias("n"))


def score_guards(judged: DataFrame, vocabulary: DataFrame, lines: DataFrame, established: int = 3, letters: str = "[一-鿿]", script: tuple[str, str] = ("", "")) -> DataFrame:
    """One row: proposals, accepted, rejected, suspect, displaces. judged: before, after, accepted; lines: the corpus (text)."""
    totals = judged.agg(F.count("*").alias("proposals"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
    good = judged.where("accepted").groupBy("before", "after").agg(F.count("*").alias("_times"))
    words = good.select("before", "after", "_times", F.explode(diff_terms(F.col("before"), F.col("after"), letters, script)).alias("d"))
    words = words.select("before", "after", "_times", F.col("d.wrong").alias("was"), F.col("d.right").alias("now"))
    suspect = words.join(vocabulary.select(F.col("gram").alias("was"), "n"), "was").where(F.col("n") >= established).agg(F.coalesce(F.sum("_times"), F.lit(0)).alias("suspect"))
    asked = words.select(F.explode(F.array("was", "now")).alias("term")).distinct()
    spoken = occurrences(lines, asked).withColumnRenamed("term", "word").join(lines.groupBy("text").agg(F.count("*").alias("_lines")), "text")
    said = spoken.groupBy("word").agg(F.sum(F.col("_lines") * (F.length("text") - F.length(F.replace("text", F.col("word")))) / F.length("word")).alias("k"))
    both = words.join(said.select(F.col("word").alias("was"), F.col("k").alias("a")), "was", "left").join(said.select(F.col("word").alias("now"), F.col("k").alias("b")), "now", "left")
    hit = both.where((F.coalesce("a", F.lit(0.0)) >= established) & (F.coalesce("a", F.lit(0.0)) > F.coalesce("b", F.lit(0.0))))
    displaced = hit.select("before", "after", "_times").distinct().agg(F.coalesce(F.sum("_times"), F.lit(0)).alias("displaces"))
    return totals.join(suspect).join(displaced)


def edit_correction(corrections: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits that may be made, refused ones with a reason). edits: key (the wrong side now), wrong, right."""
    keys = corrections.select(F.col("wrong").alias("_k")).distinct()
    known = edits.join(keys, edits["key"] == keys["_k"], "left").withColumnRenamed("_k", "_has")
    clash = known.join(keys, known["wrong"] == keys["_k"], "left").withColumnRenamed("_k", "_clash")
    reason = F.when(F.col("_has").isNull(), "unknown").when((F.trim("wrong") == "") | (F.trim("right") == ""), "blank").when(F.trim("wrong") == F.trim("right"), "itself")
    judged = clash.withColumn("reason", reason.when(F.col("_clash").isNotNull() & (F.col("wrong") != F.col("key")), "taken")).drop("_has", "_clash")
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")
