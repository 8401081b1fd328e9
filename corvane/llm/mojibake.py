"""Text read in a wrong character set, found and restored (problem 6).

Method: expectation-maximization over latent encoding chains. A chain says that bytes of one character set
were read in another (maybe twice); undoing it turns an observed word into a candidate form, where it can
be undone at all. Whole stretches are garbled, not single words, so the latent variable is the slot's: a
title or paragraph went through a chain or not, and if so, a share of its words that is itself unknown did.
The model has two parts that are learnt together: how often each clean form occurs in all records (with a
character model behind it for forms not seen elsewhere), and how often each chain is at work per source
(root) and field (title, head, body). E-step: every word weighs its form's probability against its own
being clean; the slot's words and the share of its source and field give the posterior of slot and chain,
and that the words'. M-step: expected counts of clean forms, so that a garbled word's mass moves to the
form it stands for, characters learnt anew from them, and expected shares of the chains, so that weak
evidence is pooled over the records of a source and field. A slot is affected when the posterior of a
chain is above one half, or when it holds the replacement character, whose original is lost.

Scale: records are read once, and only their words beyond ASCII travel. The loop works on the words that
some chain may explain, which are few; every other word takes part as a number of its slot. Tables of types are joined by word or form. The character model is four histograms
of fixed size, the only thing that is broadcast. Numbers part words and are no part of them.

Defined results: null titles and paragraphs have no rows; rows delivered twice count once; words in
which no chain can be undone are clean; of several chains with one form the likeliest is named.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import cut_lineage, spread

# Chains "true set<read as"; several steps are undone from left to right.
CHAINS = (
    "utf-8<cp1252", "utf-8<cp1252 utf-8<cp1252", "utf-8<cp1251", "utf-8<mac_roman", "utf-8<cp850", "utf-8<cp437",
    "utf-8<cp1250", "utf-8<cp866", "utf-8<koi8_r", "utf-8<cp1253", "utf-8<iso8859_15",
    "cp1252<mac_roman", "cp1252<cp437", "cp1252<cp850", "cp1252<cp1251", "cp1252<koi8_r", "cp1252<cp1253",
    "cp1251<cp1252", "cp1251<koi8_r", "cp1251<cp866", "cp1251<mac_roman", "koi8_r<cp1251", "koi8_r<cp1252", "cp866<cp1251", "cp866<cp1252",
    "cp1253<cp1252", "cp1253<cp1251", "shift_jis<cp1252", "euc_jp<cp1252", "shift_jis<mac_roman", "shift_jis<cp437", "shift_jis<cp850",
    "mac_roman<cp1252",
)
LOST = chr(0xFFFD)  # the replacement character
_TOKEN = re.compile(r"[^ \t\r\n0-9]+")
_EDGE = ".,;:!?()\"'<>*/-=+&#"
_INNER = "[]{}|\\_@^`~"  # these may be second bytes of a character, so they go only where no byte beyond ASCII precedes
_BUCKETS = 1 << 18
_LETTER_CASE = {"lower": math.log(0.85), "title": math.log(0.12), "upper": math.log(0.029), "mixed": math.log(0.001)}
#: Shares of a garbled slot's words that may have gone through the chain, equally likely.
TOUCHED = (0.1, 0.5, 0.95)


@cache
def _reverse(charset: str) -> dict[str, int]:
    """Byte of each character beyond ASCII; undefined bytes stand for themselves, as lenient readers do."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if charset == "cp1252":
        for b in range(128, 160):
            out.setdefault(chr(b), b)
    return out


def undo(word: str, step: str) -> str | None:
    """The word with one step undone, or None. Runs of characters that the step can't have made stay as they are."""
    true, read = step.split("<")
    back = _reverse(read)
    out, run, changed = [], bytearray(), False
    single = true not in ("utf-8", "shift_jis", "euc_jp")

    def flush() -> bool:
        if run:
            try:
                out.append(bytes(run).decode(true))
            except UnicodeDecodeError:
                return False
            run.clear()
        return True

    for c in word:
        if c < "\x80":
            if run and not single and true != "utf-8":  # trail bytes of these sets may be ASCII
                run.append(ord(c))
                continue
            if not flush():
                return None
            out.append(c)
        elif c in back:
            run.append(back[c])
            changed = True
        elif not single:
            if not flush():
                return None
            out.append(c)
        else:
            return None
    if not flush():
        return None
    text = "".join(out)
    return text if changed and text != word else None


def candidates(word: str) -> list[tuple[str, str, int]]:
    """(chain, form, sequences) for every chain that can be undone; sequences counts the UTF-8 sequences that were valid."""
    out: list[tuple[str, str, int]] = []
    for chain in CHAINS:
        form: str | None = word
        sequences = 0
        for step in chain.split():
            form = undo(form, step) if form is not None else None
            if form is not None and step.startswith("utf-8"):
                sequences += sum(c > "\x7f" for c in form)
        if form is not None and form != word and not any("\x80" <= c < "\xa0" for c in form):
            out.append((chain, form, sequences))
    return out


def words_of(text: str) -> list[tuple[int, str]]:
    """(place, word): the words beyond ASCII, without numbers and punctuation at their edges."""
    out = []
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t.isascii():
            continue
        start = len(t) - len(t.lstrip(_EDGE + _INNER))
        t = t.lstrip(_EDGE + _INNER).rstrip(_EDGE)
        while t and t[-1] in _INNER and t[-2:-1].isascii():
            t = t[:-1].rstrip(_EDGE)
        out.append((m.start() + start, t))
    return out


def _slots(records: DataFrame, units: DataFrame) -> DataFrame:
    """A row per title or paragraph with words beyond ASCII: (ref, h, kind, source, slot, field, lost, m, words).

    h tells versions of a record apart, m is the number of different words, words has them with their counts.
    """
    r = records.select("ref", "kind", "title", "paragraphs").where(F.col("ref").isNotNull())
    r = r.withColumn("h", F.xxhash64("title", "paragraphs"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ref, kind, title, ps, h in b.itertuples(index=False):
                for slot, text in enumerate([title, *(ps if ps is not None else [])], -1):
                    if text is None or text.isascii():
                        continue
                    field = "title" if slot < 0 else "head" if slot == 0 else "body"
                    seen = Counter(w for _, w in words_of(text))
                    rows.append((ref, h, kind, slot, field, LOST in text, len(seen), [{"word": w, "n": n} for w, n in seen.items()]))
            yield pd.DataFrame(rows, columns=["ref", "h", "kind", "slot", "field", "lost", "m", "words"])

    schema = "ref string, h bigint, kind string, slot int, field string, lost boolean, m int, words array<struct<word: string, n: int>>"
    s = spread(r).mapInPandas(parse, schema)
    u = units.select(F.col("id").alias("ref"), F.col("root_id").alias("source")).where("ref IS NOT NULL").groupBy("ref").agg(F.min("source").alias("source"))
    s = s.join(u, "ref", "left").withColumn("source", F.coalesce("source", F.lit(-1)))
    return cut_lineage(s.dropDuplicates(["ref", "h", "slot"]))


def _kind(c: int) -> int:
    """Script of a character: Latin, Greek, Cyrillic, other letters by 256, and 0 for what is no letter."""
    return 1 + (0 if c < 0x370 else c >> 8) if chr(c).isalpha() else 0


def _hashes(word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of a word's characters, of pairs, of pairs of a script and a character, and of scripts alone."""
    codes = [2, *map(ord, word.lower()), 3]
    p, k = np.array(codes, dtype=np.int64), np.array([_kind(c) if c > 3 else 256 + c for c in codes[:-1]], dtype=np.int64)
    return p % _BUCKETS, (p[:-1] * 1_000_003 + p[1:] * 7919) % _BUCKETS, (k * 1_000_033 + p[1:] * 104_729 + 17) % _BUCKETS, k % _BUCKETS


class Characters:
    """Probability of a word from its characters and capitals.

    Pairs of characters are backed by pairs of a script and a character, and these by single characters.
    """

    def __init__(self, counts: np.ndarray, weight: float = 2.0):
        self.one, self.two, self.mixed, self.kind = np.maximum(counts, 0).reshape(4, _BUCKETS)
        self.all, self.weight = self.one.sum() + 0.02 * 4096, weight

    def log(self, word: str) -> float:
        one, two, mixed, kind = _hashes(word)
        alone = (self.one[one[1:]] + 0.02) / self.all
        backed = (self.mixed[mixed] + self.weight * alone) / (self.kind[kind] + self.weight)
        p = (self.two[two] + self.weight * backed) / (self.one[one[:-1]] + self.weight)
        letters = [c for c in word if c.lower() != c.upper()]
        capitals = sum(c != c.lower() for c in letters)
        case = "lower" if capitals == 0 else "title" if capitals == 1 and letters[0] != letters[0].lower() else "upper" if capitals == len(letters) else "mixed"
        return float(np.log(p).sum()) + _LETTER_CASE[case]


def _learn(types: DataFrame) -> Characters:
    """The character model of (word, n); the histograms have a fixed size, counts may be negative corrections."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(4 * _BUCKETS)
        for b in batches:
            for w, n in zip(b["word"], b["n"]):
                for k, at in enumerate(_hashes(w)):
                    np.add.at(total, at + k * _BUCKETS, n)
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    h = types.select("word", "n").mapInPandas(count, "bucket int, n double").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(4 * _BUCKETS)
    out[h["bucket"].values] = h["n"].values
    return Characters(out)


def _probability(count: Column, base: Column, total: float, backoff: float) -> Column:
    """log of a form's probability: its expected count, backed by its characters."""
    return F.log((1 - backoff) * F.greatest(count, F.lit(0.0)) / total + backoff * F.exp(base) + 1e-300)


def decide(slots: DataFrame, rounds: int = 4, doubt: float = 0.02) -> DataFrame:
    """(ref, h, slot, kind, word, chain, form, odds, slot_posterior, posterior): words that a chain may explain, by EM.

    doubt is the share of garbled slots that the first round expects. The character model has the weight that
    new words have by Good and Turing, the share of words seen once. That a garbled spelling occurs often says nothing for it: the first round takes no word as seen before
    whose form is as frequent or looks far better, and a clean one gets its count back where its slots speak against the chain.
    """
    spark = slots.sparkSession
    # luck: other text would make a valid UTF-8 sequence by chance once in 16 times at most
    types = cut_lineage(slots.select(F.explode("words").alias("w")).groupBy("w.word").agg(F.sum("w.n").cast("double").alias("n")))
    total, single = (float(v or 1) for v in types.agg(F.sum("n"), F.sum((F.col("n") == 1).cast("int"))).first())
    backoff = min(0.5, single / total)
    share_of = slots.groupBy("source", "field").agg(F.count("*").alias("slots"))

    def expand(model):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            characters = model.value
            for b in batches:
                rows = []
                for w, n in zip(b["word"], b["n"]):
                    known = candidates(w)
                    own = characters.log(w) if known else 0.0
                    rows += [(w, n, chain, form, own, characters.log(form), math.log(16) * sequences) for chain, form, sequences in known]
                yield pd.DataFrame(rows, columns=["word", "n", "chain", "form", "own", "base", "luck"])

        return run

    def again(model):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            characters = model.value
            for b in batches:
                yield b.assign(own=[characters.log(w) for w in b["word"]], base=[characters.log(f) for f in b["form"]])

        return run

    schema = "word string, n double, chain string, form string, own double, base double, luck double"
    pairs = spread(types).mapInPandas(expand(spark.sparkContext.broadcast(_learn(types))), schema)
    pairs = pairs.join(types.select(F.col("word").alias("form"), F.col("n").alias("seen")), "form", "left").fillna(0.0, ["seen"])
    r = lambda count: F.col("luck") + _probability(F.col("seen"), F.col("base"), total, backoff) - _probability(count, F.col("own"), total, backoff)
    # its count speaks for a word from the start, unless the form is as frequent or looks far better
    start = F.when((F.col("seen") >= F.col("n")) | (F.col("luck") + F.col("base") - F.col("own") > 5), 0.0).otherwise(F.col("n") - 1)
    # below this a word is rather clean even in a slot most of which went through the chain
    pairs = cut_lineage(pairs.where(r(start) > math.log((1 - max(TOUCHED)) / max(TOUCHED))))
    each = slots.select("ref", "h", "slot", "kind", "source", "field", "m", F.explode("words").alias("w")).select("*", "w.word", F.col("w.n").alias("k")).drop("w")
    each = cut_lineage(each.join(pairs.select("word").distinct(), "word", "left_semi").withColumn("clean", F.lit(0.0)))
    before = math.log(doubt / len(CHAINS)) - math.log(1 - doubt)
    shares = moved = None
    for step in range(rounds):
        if moved is None:
            x = pairs.withColumns({"gain": F.col("luck") + _probability(F.col("seen"), F.col("base"), total, backoff), "left": start})
        else:
            out_of = moved.groupBy("word").agg(F.sum("n").alias("out"))
            into = moved.groupBy("form").agg(F.sum("n").alias("in"))
            change = out_of.select("word", (-F.col("out")).alias("n")).unionByName(into.select(F.col("form").alias("word"), F.col("in").alias("n")))
            model = spark.sparkContext.broadcast(_learn(types.unionByName(change)))
            x = pairs.mapInPandas(again(model), pairs.schema).join(out_of, "word", "left").join(into, "form", "left")
            x = x.join(out_of.select(F.col("word").alias("form"), F.col("out").alias("form_out")), "form", "left")
            x = x.join(moved.select("word", "chain", F.col("n").alias("own_n"), F.col("k").alias("own_k")), ["word", "chain"], "left").fillna(0.0, ["out", "in", "form_out", "own_n", "own_k"])
            part = F.when(F.col("own_k") > 0, F.col("own_n") / F.col("own_k")).otherwise(0.0)  # of the occurrence itself, which is no evidence for itself
            form = _probability(F.col("seen") - F.col("form_out") + F.col("in") - part, F.col("base"), total, backoff)
            x = x.withColumns({"gain": F.col("luck") + form, "left": F.col("n") - F.col("out")})
        # an occurrence's own share of the word's clean count says nothing for it
        y = each.join(x.select("word", "chain", "form", "gain", "own", "left"), "word")
        y = y.withColumn("r", F.least(F.col("gain") - _probability(F.col("left") - F.col("k") * F.col("clean"), F.col("own"), total, backoff), F.lit(500.0)))
        y = y.drop("gain", "own", "left", "clean").repartition("ref", "h", "slot")
        if shares is None:
            y = y.withColumn("odds", F.lit(before))
        else:
            y = y.join(shares, ["source", "field", "chain"], "left").fillna(before, ["odds"])
        whole, own = Window.partitionBy("ref", "h", "slot", "chain"), Window.partitionBy("ref", "h", "slot", "word")
        touched = lambda t: F.log(1 - t + t * F.exp("r"))
        y = y.withColumn("met", F.count("*").over(whole))
        y = y.withColumn("e", F.array(*[F.sum(touched(t)).over(whole) + (F.col("m") - F.col("met")) * math.log(1 - t) for t in TOUCHED]))
        y = y.withColumn("top", F.array_max("e")).withColumn("e", F.transform("e", lambda v: F.exp(v - F.col("top"))))
        y = y.withColumn("sum", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
        y = y.withColumn("odds", F.exp(F.least(F.col("odds") + F.col("top") + F.log(F.col("sum") / len(TOUCHED)), F.lit(30.0))))
        word = sum((F.col("e")[i] * t * F.exp("r") / (1 - t + t * F.exp("r")) for i, t in enumerate(TOUCHED)), F.lit(0.0)) / F.col("sum")
        y = y.withColumn("p", F.col("odds") / (1 + F.col("odds")) * word)
        # of several chains the word goes to the likelier ones
        y = y.withColumn("weight", F.col("p") * F.exp(F.col("r") - F.max("r").over(own)))
        y = y.withColumn("any", F.sum(F.col("p") / (1 - F.col("p"))).over(own))
        y = y.withColumn("posterior", F.col("any") / (1 + F.col("any")) * F.col("weight") / F.greatest(F.sum("weight").over(own), F.lit(1e-300)))
        if step == rounds - 1:
            y = y.withColumn("any", F.sum(F.col("odds") / F.col("met")).over(Window.partitionBy("ref", "h", "slot")))
            return y.select("ref", "h", "slot", "kind", "word", "chain", "form", "odds", (F.col("any") / (1 + F.col("any"))).alias("slot_posterior"), "posterior")
        y = y.withColumn("slot_posterior", F.col("odds") / (1 + F.col("odds")))
        y = y.withColumn("clean", 1 - F.col("any") / (1 + F.col("any")))
        y = cut_lineage(y.select(*each.columns, "chain", "form", "posterior", (F.col("slot_posterior") / F.col("met")).alias("part")))
        each = y.groupBy(*[c for c in each.columns if c != "clean"]).agg(F.first("clean").alias("clean"))
        moved = cut_lineage(y.groupBy("word", "chain", "form").agg(F.sum(F.col("k") * F.col("posterior")).alias("n"), F.sum("k").cast("double").alias("k")))
        seen = y.groupBy("source", "field", "chain").agg(F.sum("part").alias("g")).join(share_of, ["source", "field"])
        seen = seen.withColumn("share", (F.col("g") + 50 * doubt / len(CHAINS)) / (F.col("slots") + 50))
        clear = F.greatest(1 - F.sum("share").over(Window.partitionBy("source", "field")), F.lit(0.05))
        shares = cut_lineage(seen.select("source", "field", "chain", (F.log("share") - F.log(clear)).alias("odds")))
    raise ValueError("at least one round is needed")


def garbled_slots(records: DataFrame, units: DataFrame) -> DataFrame:
    """(ref, slot): titles (-1) and paragraphs of source records that hold a garbled stretch."""
    s = _slots(records, units)
    hit = decide(s).where("kind = 'source' AND slot_posterior > 0.5").select("ref", "slot")
    return hit.unionByName(s.where("kind = 'source' AND lost").select("ref", "slot")).distinct()


def repaired_slots(records: DataFrame, units: DataFrame) -> DataFrame:
    """(ref, slot, n_repaired, n_lost, repaired): affected slots with every garbled word put right.

    Words whose characters are lost stay as they are and are counted.
    """
    s = _slots(records, units)
    d = decide(s).where("kind = 'source' AND slot_posterior > 0.5").groupBy("ref", "h", "slot", "word")
    d = d.agg(F.max_by("chain", F.struct("posterior", "odds", "chain")).alias("chain"), F.sum("posterior").alias("posterior"))
    d = d.select("ref", "h", "slot", F.when(F.col("posterior") > 0.5, F.col("word")).alias("word"), "chain")
    lost = s.where("kind = 'source' AND lost").select("ref", "h", "slot", F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("chain"))
    fix = d.unionByName(lost).groupBy("ref", "h").agg(F.collect_set(F.struct("slot", "word", "chain")).alias("fixes"))
    r = records.where("kind = 'source'").select("ref", "title", "paragraphs").withColumn("h", F.xxhash64("title", "paragraphs")).dropDuplicates(["ref", "h"]).join(fix, ["ref", "h"]).drop("h")
    schema = "ref string, slot int, n_repaired int, n_lost int, repaired string"

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ref, title, ps, fixes in b.itertuples(index=False):
                texts = [title, *(ps if ps is not None else [])]
                by: dict[int, dict[str, str]] = {}
                for f in fixes:
                    by.setdefault(f["slot"], {}).update({f["word"]: f["chain"]} if f["word"] else {})
                for slot, known in by.items():
                    text, out, done, last = texts[slot + 1] or "", [], 0, 0
                    lost = 0
                    for at, word in words_of(text):
                        lost += LOST in word
                        form: str | None = word if word in known else None
                        for step in known.get(word, "").split():
                            form = undo(form, step) if form is not None else None
                        if form is not None:
                            out += [text[last:at], form]
                            last, done = at + len(word), done + 1
                    rows.append((ref, slot, done, lost, "".join([*out, text[last:]])))
            yield pd.DataFrame(rows, columns=["ref", "slot", "n_repaired", "n_lost", "repaired"])

    return r.mapInPandas(mend, schema)
