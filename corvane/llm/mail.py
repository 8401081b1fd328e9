"""Newly written text of e-mails (problem 4).

Method: a mail is cut into blocks (lines of one paragraph with one kind of quote mark; closing formulas,
rules, introductions and header lines stand alone). Each block gets features: quote depth and indent,
place relative to introductions, separators and the start of the signature, density of contact data,
share of the sender's name, cues of closings, devices and legal notices, how often the block's text occurs
from this sender and from how many senders, and how much of it stands in an earlier mail of the thread
(ancestor overlap). Gradient-boosted trees, trained here, classify the blocks; the lines of blocks that
are classified as new are the result.

Labels: the tables hold none, so the trees learn from blocks whose class several features agree on (weak
labels, see _weak_label); blocks on which they don't agree are left to the trees. The training sample is
bounded by train_blocks and drawn by a hash of the mail; everything else covers all mails.

Scale: mails are parsed once. Frequencies are counts per text hash; ancestor overlap is a minimum of the
sending time per (thread, five-word hash), aggregated before it is joined back, so that no thread, however
long, is ever gathered in one task.

Defined results: rows with null paragraphs, other converters or no body have no lines; blank lines are never
new; mails without thread id use their subject; mails without a readable date have no ancestors; rows given twice count once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from email.utils import parsedate_to_datetime
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import cut_lineage, spread

# Patterns of lines in mails, by kind.
MARK = r"^\s*(?:>|\||:(?=\s|$)|»|[A-Z]{2,3}>)\s?"
SEPARATOR = r"^\s*[-_*=]{2,}\s*(?:original|forwarded|weitergeleitete|ursprüngliche|message d.origine|mensaje|begin)[\w\s’']*[-_*=]*"
HEADER = r"^\s*\*?(?:from|von|de|da|sent|gesendet|envoyé|enviado|date|datum|fecha|to|an|à|para|cc|subject|betreff|objet|asunto|assunto)\*?\s*:\s"
HEADER_FIRST = r"^\s*\*?(?:from|von|de|da)\*?\s*:\s"
SAYING = r"(?:wrote|said|writes|schrieb|a écrit|escribió|escreveu|ha scritto)\b[^.!?]{0,40}:\s*$"
CLOSING = (
    r"^\s*(?:(?:kind|best|warm|many)?\s*regards|best(?: wishes)?|yours(?: \w+)?|sincerely|cheers|(?:many )?thanks|thank you|br|rgds|cordialement|"
    r"bien à vous|salutations|mit freundlichen grüßen|viele grüße|liebe grüße|gruß|grüße|mfg|saludos(?: cordiales)?|un saludo|atentamente|atenciosamente|"
    r"cumprimentos|abraços?|cordiali saluti|ciao)\s*[,.!]?(?:\s+[\w.’'-]+){0,3}\s*$"
)
DEVICE = r"^\s*(?:sent (?:from|via|with)|get \w+(?: \w+){0,3} (?:for|on) |envoyé de(?:puis)? |von unterwegs|gesendet (?:von|mit)|enviado (?:desde|do|a partir)|inviato da)"
LEGAL = (
    "confiden, privileg, unauthorised, unauthorized, disclosure, intended, named reader, reached you in error, vertraulich, empfänger, courriel, pièces jointes, "
    "e-mail, this mail, this message, views are those, before printing, attachment, mailing list, to leave, write, unsubscribe, liabilit, late delivery, "
    "destroy every copy, destinatari"
)
CONTACT_HINTS = "@ tel phone fax mobil + office sprech http www floor shed"
CONTACT = r"[\w.+-]+@[\w-]+\.\w+|\btel\b|\bphone\b|\bfax\b|\bmobile?\b|\+\d[\d ]{5,}|\boffice hours\b|\bsprechzeiten\b|https?://|www\.|\b\d+(?:st|nd|rd|th) floor\b|\bshed \d+"
RULE = r"^\s*(?:-- ?|—|–|[_*=~-]{3,})\s*$"
_RX = {k: re.compile(v, re.IGNORECASE) for k, v in {"sep": SEPARATOR, "header": HEADER, "first": HEADER_FIRST, "say": SAYING, "close": CLOSING, "device": DEVICE, "contact": CONTACT}.items()}
_MARK, _RULE = re.compile(MARK), re.compile(RULE)
_LEGAL, _HINTS = LEGAL.replace("to leave, write", "to leave; write").split(", "), CONTACT_HINTS.split()
_LEGAL = [x.replace(";", ",") for x in _LEGAL]
_WORD = re.compile(r"[^\W_]+")
_ENDED, _NUMBER = re.compile(r"[.!?;:。…][\"”’')]*$"), re.compile(r"\d+")
_HEADED = re.compile(r"\b(?:Sent|To|Subject|Date|Gesendet|An|Betreff|Datum|Envoyé|Objet|Enviado|Para|Asunto)\*?:")
_RE = re.compile(r"^(?:\s*(?:re|aw|fw|fwd|wg|tr|rv)\s*:)+\s*", re.IGNORECASE)

ALONE = (
    "depth", "indent", "lines", "words", "intro", "header", "after_intro", "contact", "name", "closing", "rule", "device", "legal",
    "from_end", "sentence", "one_line", "marked_others",
)
SHARED = ("overlap", "shingles", "overlap_others", "sender_count", "count", "senders")
SEQUENCE = ("below", "open", "own_seen", "signed")
FEATURES = ALONE + SHARED + SEQUENCE
_AT = {n: i for i, n in enumerate(FEATURES)}


def _unmark(line: str) -> tuple[str, int]:
    depth = 0
    if line[:1].isalnum() and ">" not in line[:4]:  # most lines: no mark
        return line, 0
    while m := _MARK.match(line):
        line, depth = line[m.end() :], depth + 1
    return line, depth


def _name_words(sender: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(re.sub(r"<.*?>|\S+@\S+", "", sender)) if len(w) > 1}


def parse(paragraphs: list[str]) -> tuple[dict, list[dict]]:
    """Head (sender, time, subject) and blocks of a mail."""
    head: dict = {"sender": "", "subject": "", "time": None}
    for line in (paragraphs[0] or "").split("\n") if len(paragraphs) else []:
        key, _, value = line.partition(":")
        key = key.strip().lower()
        if key == "from":
            head["sender"] = value.strip()
        elif key == "subject":
            head["subject"] = _RE.sub("", value.strip()).lower()
        elif key == "date":
            try:
                head["time"] = int(parsedate_to_datetime(value.strip()).timestamp())
            except (ValueError, TypeError, OverflowError):
                pass
    blocks: list[dict] = []
    for para, text in enumerate(paragraphs):
        if para == 0 or text is None:
            continue
        lines = text.split("\n")
        current: dict | None = None
        for at, raw in enumerate(lines):
            if not raw.strip():
                current = None
                continue
            line, depth = _unmark(raw)
            indent = int(depth == 0 and raw.startswith("    "))
            bare = line.strip()
            header = bool(_RX["sep"].match(bare) or (_RX["header"].match(bare) and (_RX["first"].match(bare) or (current and current["header"]))))
            if header and _RX["first"].match(bare) and not _RX["sep"].match(bare):  # a header's first line needs a second one
                following = " ".join(_unmark(x)[0] for x in lines[at + 1 : at + 3])
                header = bool(_RX["header"].match(following.strip()) or _HEADED.search(bare))
            intro = bool(_RX["say"].search(bare)) and len(bare) < 160
            alone = "header" if header else "intro" if intro else "close" if _RX["close"].match(bare) else "rule" if _RULE.match(raw if depth == 0 else bare) else "device" if _RX["device"].match(bare) else ""
            kind = (depth > 0, indent, alone)
            if current is None or current["kind"] != kind or alone in ("rule", "intro"):
                if alone == "intro" and current is not None and current["para"] == para and len(current["at"]) == 1 and current["kind"][:2] == kind[:2] and current["kind"][2] == "" and (bare[0].islower() or len(bare.split()) <= 6 or current["text"].rstrip().endswith(",")):
                    current["kind"], current["header"] = kind, 0  # an introduction of two lines
                    current["at"].append(at)
                    current["text"] += "\n" + line
                    continue
                current = {"para": para, "at": [], "text": "", "depth": 0, "kind": kind, "header": int(header)}
                blocks.append(current)
            current["at"].append(at)
            current["text"] += ("\n" if current["text"] else "") + line
            current["depth"] = max(current["depth"], depth)
    return head, blocks


@lru_cache(maxsize=200_000)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def _shingles(words: list[str]) -> np.ndarray:
    """Hashes of the runs of five words; the words are in lower case."""
    if len(words) < 5:
        return np.empty(0, dtype=np.int64)
    w = np.fromiter(map(_word_hash, words), dtype=np.uint64, count=len(words))
    h = np.zeros(len(w) - 4, dtype=np.uint64)
    for k in range(5):
        h = (h ^ w[k : len(w) - 4 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def describe(head: dict, blocks: list[dict]) -> np.ndarray:
    """The features of the blocks that a mail alone gives; columns as in ALONE. Leaves each block's words in it."""
    out = np.zeros((len(blocks), len(ALONE)), dtype=np.float32)
    name = _name_words(head["sender"])
    marked = sum(b["depth"] > 0 for b in blocks)
    initials = {n[0] for n in name}
    for k, b in enumerate(blocks):
        text, (_, indent, alone) = b["text"], b["kind"]
        words = b["words"] = _WORD.findall(text)
        low = text.lower()
        hits = _RX["contact"].findall(text) if any(h in low for h in _HINTS) else []
        share = 0.0  # only short blocks are names
        if len(words) < 12:
            share = sum(w.lower() in name or (len(w) <= 3 and w.isupper() and w[0].lower() in initials) for w in words) / max(1, len(words))
        values = {
            "depth": b["depth"], "indent": indent, "lines": len(b["at"]), "words": len(words), "intro": alone == "intro", "header": alone == "header",
            "after_intro": k > 0 and blocks[k - 1]["kind"][2] == "intro", "contact": len(hits) / max(1, len(words) / 4), "name": share,
            "closing": alone == "close", "rule": alone == "rule", "device": alone == "device", "legal": sum(x in low for x in _LEGAL),
            "from_end": len(blocks) - k, "sentence": len(words) >= 5 and not hits and bool(_ENDED.search(text.strip())),
            "one_line": len(b["at"]) == 1, "marked_others": marked - (b["depth"] > 0),
        }
        out[k] = [values[n] for n in ALONE]
    return out


def _machinery(v) -> bool:
    """Closing formula, rule, device line, the sender's name, contact data or a notice."""
    return bool(v["closing"] or v["rule"] or v["device"] or (v["name"] >= 0.5 and v["words"] <= 8) or v["contact"] >= 0.5 or v["legal"] > 1 or (v["legal"] and v["senders"] >= 3))


def follow(x: np.ndarray) -> np.ndarray:
    """SEQUENCE features of a mail's blocks in order, from the others.

    below: after a header block or separator, or an introduction whose quotation is indented. open: in an
    unmarked quotation after an introduction, until a block that is in no earlier mail follows blocks
    that are. own_seen: own text came before. signed: own text and then a signature came before or here.
    """
    out = np.zeros((len(x), len(SEQUENCE)), dtype=np.float32)
    below = open_ = own = signed = copied = False
    any_marked = bool((x[:, _AT["depth"]] > 0).any())
    for k, row in enumerate(x):
        v = {n: row[i] for n, i in _AT.items() if i < len(row)}
        plain = v["depth"] == 0 and not v["indent"]
        if plain and v["header"]:
            below = True
        elif plain and v["intro"] and k + 1 < len(x):
            after = x[k + 1]
            if after[_AT["indent"]]:
                below = True
            elif after[_AT["depth"]] == 0 and not any_marked:
                open_, copied = True, False
        elif open_ and plain and v["sentence"]:
            if v["overlap"] >= 0.5:
                copied = True
            elif copied and v["overlap"] < 0.3 and not v["legal"]:
                open_ = False
        if plain and not below and not open_ and not signed:
            if own and _machinery(v) and not v["sentence"]:
                signed = True
            elif not _machinery(v) and v["overlap"] < 0.5 and not v["intro"]:
                own = True
        out[k] = below, open_, own, signed
    return out


class Trees:
    """Gradient-boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, rounds: int = 80, depth: int = 5, rate: float = 0.2, bins: int = 48, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)))[:-1] for j in range(x.shape[1])]
        for j in range(x.shape[1]):  # rare values get edges of their own
            rare = np.unique(x[:, j])
            if len(rare) <= self.bins:
                self.edges[j] = (rare[:-1] + rare[1:]) / 2
        b, share = self._bin(x), min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        n_nodes, width, columns = 2 ** (self.depth + 1) - 1, self.bins + 1, x.shape[1]
        for _ in range(self.rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            feature, cut, value = np.full(n_nodes, -1), np.zeros(n_nodes, dtype=np.int64), np.zeros(n_nodes)
            node = np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth + 1):
                first, count = 2**level - 1, 2**level
                at = node - first
                live = at >= 0
                sums = [np.bincount(at[live], weights=v[live], minlength=count) for v in (g, h)]
                value[first : first + count] = sums[0] / (sums[1] + 1.0)
                if level == self.depth:
                    break
                gain = np.zeros((columns, count, width))
                for j in range(columns):
                    key = at[live] * width + b[live, j]
                    gj = np.cumsum(np.bincount(key, weights=g[live], minlength=count * width).reshape(count, width), axis=1)
                    hj = np.cumsum(np.bincount(key, weights=h[live], minlength=count * width).reshape(count, width), axis=1)
                    gr, hr = gj[:, -1:] - gj, hj[:, -1:] - hj
                    gain[j] = gj**2 / (hj + 1) + gr**2 / (hr + 1) - (gj[:, -1:] ** 2) / (hj[:, -1:] + 1)
                    gain[j][(hj < self.least / 8) | (hr < self.least / 8)] = 0
                flat = gain.transpose(1, 0, 2).reshape(count, -1)
                best = flat.argmax(axis=1)
                for c in range(count):
                    if flat[c, best[c]] > 1e-6:
                        feature[first + c], cut[first + c] = best[c] // width, best[c] % width
                f = feature[node]
                split = live & (f >= 0)
                right = b[np.arange(len(b)), np.maximum(f, 0)] > cut[node]
                node = np.where(split, 2 * node + 1 + right, np.where(live, -1 - node, node))
            leaf = np.where(node < 0, -1 - node, node)
            score += self.rate * value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        score = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 1 + (b[rows, np.maximum(f, 0)] > cut[node]), node)
            score += self.rate * value[node]
        return 1 / (1 + np.exp(-score))


def _weak_label(x: np.ndarray) -> np.ndarray:
    """1 new, 0 not new, -1 undecided, from feature rows."""
    v = {n: x[:, i] for n, i in _AT.items()}
    copied = (v["overlap"] >= 0.75) & (v["shingles"] >= 4)
    marked = v["depth"] > 0
    frame = (v["header"] + v["intro"] + v["below"] + v["open"] + v["signed"] > 0) | (v["indent"] > 0) & (v["overlap"] > 0.3)
    machinery = (v["closing"] + v["rule"] + v["device"] > 0) | ((v["name"] >= 0.5) & (v["words"] <= 8)) | (v["contact"] >= 0.5) | (v["legal"] > 1) | ((v["legal"] > 0) & (v["senders"] >= 3))
    # a single marked line that is in no earlier mail, where nothing else is marked or all else is in one
    lone = marked & (v["one_line"] > 0) & (v["after_intro"] == 0) & (v["overlap"] < 0.3) & (v["shingles"] >= 3)
    lone &= (v["marked_others"] == 0) | (v["overlap_others"] >= 0.5)
    label = np.where(frame | copied | machinery | (marked & ~lone), 0.0, 1.0)
    label[(label == 1) & ~marked & (v["overlap"] >= 0.4) & (v["shingles"] >= 4)] = -1.0
    return label


def _blocks(conversions: DataFrame) -> DataFrame:
    c = conversions.where(F.col("converter").startswith("eml") & F.col("paragraphs").isNotNull() & F.col("conv_id").isNotNull())
    c = c.select("conv_id", "paragraphs", F.col("metadata")["thread_conversation_id"].alias("thread"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for conv, ps, thread in b.itertuples(index=False):
                head, blocks = parse(list(ps))
                if not blocks:
                    continue
                x = describe(head, blocks)
                key = thread or f"subject {head['subject']}"
                sender = " ".join(sorted(_name_words(head["sender"])))
                for k, blk in enumerate(blocks):
                    plain = " ".join(blk["words"]).lower()
                    rows.append((conv, k, blk["para"], blk["at"], key, sender, head["time"], _NUMBER.sub("0", plain), _shingles(plain.split(" ")), x[k]))
            yield pd.DataFrame(rows, columns=["conv_id", "block", "para_idx", "lines", "thread", "sender", "time", "plain", "shingles", "x"])

    schema = "conv_id bigint, block int, para_idx int, lines array<int>, thread string, sender string, time bigint, plain string, shingles array<bigint>, x array<float>"
    b = spread(c).mapInPandas(cut, schema)
    return cut_lineage(b.dropDuplicates(["conv_id", "block"]).withColumn("hash", F.xxhash64("plain")).drop("plain"))


def _featured(blocks: DataFrame) -> DataFrame:
    """(conv_id, blocks): each mail's blocks in order; ancestor overlap and frequencies are joined on to x."""
    s = blocks.select("conv_id", "block", F.xxhash64("thread").alias("thread"), "time", F.explode("shingles").alias("s"))
    s = s.select("conv_id", "block", "time", F.xxhash64("thread", "s").alias("s"))
    first = s.groupBy("s").agg(F.min("time").alias("first"))
    old = s.join(first, "s").groupBy("conv_id", "block").agg(F.avg(F.coalesce(F.col("first") < F.col("time"), F.lit(False)).cast("int")).alias("overlap"))
    marked = blocks.select("conv_id", "block", (F.col("x")[0] > 0).alias("marked"))
    mails = old.join(marked, ["conv_id", "block"]).where("marked").groupBy("conv_id").agg(F.sum("overlap").alias("all"), F.count("*").alias("n"))
    by_sender = blocks.groupBy("hash", "sender").agg(F.count("*").alias("k"))
    by_text = by_sender.groupBy("hash").agg(F.sum("k").alias("kk"), F.count("*").alias("senders"))
    b = blocks.join(old, ["conv_id", "block"], "left").join(mails, "conv_id", "left").join(by_sender, ["hash", "sender"]).join(by_text, "hash")
    own = F.coalesce("overlap", F.lit(0.0))
    is_marked = (F.col("x")[0] > 0).cast("int")
    others = F.when(F.col("n") - is_marked > 0, (F.col("all") - is_marked * own) / (F.col("n") - is_marked)).otherwise(0.0)
    more = [own, F.size("shingles"), F.coalesce(others, F.lit(0.0)), F.log2("k"), F.log2("kk"), F.col("senders")]
    b = b.select("conv_id", "block", "para_idx", "lines", F.concat("x", F.array(*[m.cast("float") for m in more])).alias("x"))
    return b.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "para_idx", "lines", "x"))).alias("blocks"))


def _rows(blocks) -> np.ndarray:
    """All features of one mail's blocks."""
    x = np.array([np.asarray(k["x"], dtype=np.float32) for k in blocks])
    return np.concatenate([x, follow(x)], axis=1)


def new_lines(conversions: DataFrame, train_blocks: int = 20_000) -> DataFrame:
    """(conv_id, para_idx, line_idx): lines newly written by the mails' senders."""
    b = cut_lineage(_featured(_blocks(conversions)))
    n = b.agg(F.sum(F.size("blocks"))).first()[0] or 0
    share = min(1.0, train_blocks / max(1, n))
    # whole mails, by a hash of their number; about train_blocks blocks come to the driver, never more than so many mails
    sample = b.where(F.pmod(F.xxhash64("conv_id"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(train_blocks).toPandas().sort_values("conv_id")
    x = np.concatenate([_rows(k) for k in sample["blocks"]])[: 2 * train_blocks] if len(sample) else np.zeros((0, len(FEATURES)), dtype=np.float32)
    y = _weak_label(x) if len(x) else np.zeros(0)
    model = conversions.sparkSession.sparkContext.broadcast(Trees().fit(x[y >= 0], y[y >= 0]) if len(x) else None)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            if len(f):
                new = model.value.predict(np.concatenate([_rows(k) for k in f["blocks"]])) > 0.5
                conv = np.repeat(f["conv_id"].values, [len(k) for k in f["blocks"]])
                own = [k for blocks in f["blocks"] for k in blocks]
                kept = np.nonzero(new)[0]
                yield pd.DataFrame({"conv_id": conv[kept], "para_idx": [own[k]["para_idx"] for k in kept], "lines": [own[k]["lines"] for k in kept]})

    kept = b.mapInPandas(classify, "conv_id bigint, para_idx int, lines array<int>")
    return kept.select("conv_id", "para_idx", F.explode("lines").alias("line_idx")).distinct()


def new_text(conversions: DataFrame) -> DataFrame:
    """(conv_id, text): each mail reduced to its new lines; null where there are none."""
    c = conversions.where(F.col("converter").startswith("eml") & F.col("paragraphs").isNotNull()).select("conv_id", "paragraphs").dropDuplicates(["conv_id"])
    own = new_lines(conversions).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("para_idx", "line_idx"))).alias("at"))
    line = lambda a: F.split(F.element_at("paragraphs", a["para_idx"] + 1), "\n")[a["line_idx"]]
    return c.join(own, "conv_id", "left").select("conv_id", F.array_join(F.transform("at", line), "\n").alias("text"))
