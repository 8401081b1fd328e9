"""Variant spellings of names of persons and organisations, linked to their entity (problem 7).

Method: noisy-channel attribution. An entity's canonical forms are its title, its aliases, and the spellings that
rank as frequent among those that certainly mean it; a form costs what its share of the entity's mentions says.
What people make of a form: parts reordered, initials, nicknames, titles before the name, log-in names, abbreviations,
acronyms, dropped parts. Each distinct spelling is read in every way it can be, candidates come from an
index of deletion neighbourhoods of the telling part (surname, or the organisation's own name), and each
candidate gets a likelihood: what its reading costs, and what its typing errors cost (Damerau distance on
folded letters, so that accents, look-alike digits and common respellings are cheap). The frequency prior
of the entities is estimated from all mentions, by one expectation step over the likelihoods, so that
frequent spellings draw ambiguous ones. Each spelling goes to the entity of maximum posterior, if that
outweighs "nobody".

Scale: mentions are counted per distinct spelling before anything else; only spellings are read, and only
(spelling, entity) candidates are joined. The index of forms is sent to the tasks in blocks of at most
block_entities; several blocks are several passes over the spellings, whose candidates are united.
Titles are read first; what they explain gives the frequent forms, which are read in a second pass.

Defined results: null, empty or unreadable names, and names that fit no entity, have no row; a spelling that
fits several entities equally well goes to the more frequent one, and has no row if none reaches half of
the posterior; null and empty aliases and titles are skipped; rows given twice count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.session import cut_lineage, spread

# Short forms of given names, by the full name.
NICKNAMES = """
    alexander alex sandy sasha xander|alexandra alex sandra sandy lexie sasha xandra alix|andrew andy drew|angela angie geli|anthony tony|
    barbara barb babs|bartholomew bart barty|benjamin ben benny|bjorn bjarne bear|catherine cathy kate kit kitty cat|charles charlie chuck|
    christopher chris kit topher|christine chris tina|daniel dan danny|david dave davy|delphine del fifi|dorothy dot dolly|edward ed eddie ted ned|
    eleanor nell ellie nora ella|elizabeth liz beth betty lizzie eliza bess libby|emily em|francisco paco pancho kiko curro fran frank cisco|frances fran fanny|
    frederick fred freddie fritz|genevieve gen gene viv vieve gigi ginny eve|george geordie|gertrude gert trudy|henrietta hetty etta harriet hattie|henry harry hal hank|
    ignacio nacho|ingrid inga|isabel isa bella|james jim jimmy jamie|jean jeannot|johannes hans jo johan hannes john|john jack johnny|jonathan jon|
    jose pepe pepito joe|joseph joe joey|joshua josh|katherine kate kit kathy katie kat kay|klaus claus|lawrence larry laurie lars|leonard len leo|louis lou|
    margaret maggie meg peg peggy madge greta|maria mia|martin marty|mary molly polly|matthew matt|michael mike mick|mireille mimi|
    nicholas nick nicky klaus nico|oswin oz ossie|patricia pat patty trish tricia|patrick pat paddy|peter pete|philip phil pip|philippa pip pippa|
    quentin quin quint|rebecca becky|richard rick dick richie rich|robert bob rob bobby bert|samuel sam sammy|stephen steve|susan sue|
    theodore ted theo teddy|theresa tess|thomas tom|timothy tim|ulrich uli ulli|victoria vicky tori vic|walter walt|
    william bill will willy billy liam|winifred win|yvonne evie von|zoe zo
"""
# Words before a name that are no part of it.
TITLES = "mr mrs ms miss dr prof sir dame capt captain pilot cpt lt rev fr herr frau mme m mlle sr sra senor senora don dona harbourmaster master"
# Endings of organisations, with their short forms.
ENDINGS = {"company": "co", "corporation": "corp", "limited": "ltd", "brothers": "bros", "association": "assoc assn", "incorporated": "inc", "sons": "", "group": "", "partners": ""}

_NICK: dict[str, set[str]] = defaultdict(set)
for _line in NICKNAMES.replace("\n", "").split("|"):
    _full, *_short = _line.split()
    for _s in _short:
        _NICK[_s].add(_full)
_TITLES = set(TITLES.split())
_TOKEN = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower case without accents; blanks collapsed."""
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss"))
    return re.sub(r"\s+", " ", "".join(c for c in text if not unicodedata.combining(c))).strip().lower()


def folded(word: str) -> str:
    """Letters that are typed or read for one another, made one: accents, digits, ae/oe/ue, ph, rn."""
    w = plain(word).replace("1", "l").replace("0", "o").replace("5", "s").replace("ph", "f").replace("rn", "m").replace("ck", "k")
    return w.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def damerau(a: str, b: str, most: int = 3) -> int:
    """Optimal string alignment distance, or most + 1 beyond it."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, last = last, now
    return min(last[-1], most + 1)


@lru_cache(maxsize=200_000)
def distance(a: str, b: str) -> float:
    """Typing errors between two words; what folding makes equal costs a fraction of one."""
    pa, pb = plain(a), plain(b)
    if pa == pb:
        return 0.0
    fa, fb = folded(a), folded(b)
    return min(damerau(pa, pb), 0.4 + damerau(fa, fb))


def _deletions(word: str, most: int = 2) -> set[str]:
    out = {word}
    level = {word}
    for _ in range(most if len(word) >= 6 else 1):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out |= level
    return out


def _allowed(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2


class Channel:
    """The index of one block of canonical forms, and the likelihoods of spellings.

    A form is (entity, kind, name, cost of its being used, names that mean it as they are).
    """

    def __init__(self, forms: list[tuple]):
        self.keys: dict[str, set[int]] = defaultdict(set)
        self.whole: dict[str, set[int]] = defaultdict(set)
        self.acronyms: dict[str, set[int]] = defaultdict(set)
        self.entities = []
        self.costs: list[float] = []
        for ref, kind, title, cost, aliases in forms:
            if not title or not title.strip():
                continue
            k = len(self.entities)
            words = _TOKEN.findall(title)
            if not words:
                continue
            organisation = kind == "organisation"
            self.entities.append((ref, organisation, words))
            self.costs.append(cost)
            tell = words[0] if organisation else words[-1]
            for d in _deletions(folded(tell)):
                self.keys[d].add(k)
            for name in [title, *(aliases if aliases is not None else [])]:
                if name and name.strip():
                    self.whole[plain(name)].add(k)
            if organisation and len(words) > 2:
                self.acronyms["".join(plain(w)[0] for w in words)].add(k)

    def _near(self, word: str) -> set[int]:
        out: set[int] = set()
        for d in _deletions(folded(word)):
            out |= self.keys.get(d, set())
        return out

    @staticmethod
    def _given(typed: list[str], given: str) -> tuple[float, float] | None:
        """(cost, errors) of typed given names for the full one, or None where they contradict it."""
        if not typed:
            return 2.5, 0.0
        first, rest = typed[0], typed[1:]
        if any(len(r) > 1 for r in rest):
            return None
        extra = 0.7 * len(rest)
        g = plain(given)
        if len(first) == 1:
            return (1.5 + extra, 0.0) if plain(first) == g[0] else None
        nick = plain(first)
        if g in _NICK.get(nick, ()) and nick != g:
            return 1.2 + extra, 0.0
        e = distance(first, given)
        if e <= _allowed(g) + 0.4:
            return extra, e
        near = min((distance(nick, s) for s, full in _NICK.items() if g in full and len(s) > 3), default=9)
        return (1.4 + extra, near) if near <= 1 else None

    def _person(self, given: list[str], surname: str, out: dict[int, float], cost: float = 0.0) -> None:
        for k in self._near(surname):
            _, organisation, words = self.entities[k]
            if organisation or len(words) < 2:
                continue
            e = distance(surname, words[-1])
            g = self._given(given, words[0])
            if g is None:
                continue
            errors = e + g[1]
            if errors > _allowed(plain(words[-1])) + 0.5:
                continue
            out[k] = min(out.get(k, 99.0), cost + g[0] + 3.0 * errors)

    @staticmethod
    def _abbreviates(typed: str, word: str) -> bool:
        t, w = plain(typed), plain(word)
        if t in ENDINGS.get(w, "").split():
            return True
        if len(t) < 2 or not t or t[0] != w[0] or len(t) >= len(w):
            return False
        at = 0
        for c in t:
            at = w.find(c, at) + 1
            if not at:
                return False
        return True

    def _organisation(self, typed: list[str], out: dict[int, float]) -> None:
        for place, tell in enumerate(typed):
            for k in self._near(tell):
                _, organisation, words = self.entities[k]
                if not organisation:
                    continue
                e = distance(tell, words[0])
                if e > _allowed(plain(words[0])) + 0.5:
                    continue
                left, cost, errors = words[1:], 0.0, e
                for t in typed[:place] + typed[place + 1 :]:
                    exact = next((w for w in left if plain(w) == plain(t)), None)
                    short = exact or next((w for w in left if self._abbreviates(t, w)), None)
                    near = short or next((w for w in left if distance(t, w) <= 1.4 and len(t) > 4), None)
                    if near is None:
                        errors = 99.0
                        break
                    left.remove(near)
                    cost += 0.0 if exact else 0.4 if short else 0.0
                    errors += 0 if short else 1
                if errors <= 2.5 and len(typed) > 1:
                    out[k] = min(out.get(k, 99.0), cost + 0.3 * len(left) + 3.0 * errors)

    def likelihoods(self, name: str) -> list[tuple[str, float]]:
        """(entity, cost) of every entity that the spelling may mean; lower is likelier."""
        out: dict[int, float] = {}
        for k in self.whole.get(plain(name), ()):
            out[k] = 0.0
        text = name.strip()
        letters = text.replace(".", "").replace(" ", "")
        if letters.isalpha() and letters.isupper() and 3 <= len(letters) <= 6:
            for k in self.acronyms.get(plain(letters), ()):
                out[k] = min(out.get(k, 99.0), 0.5)
        words = _TOKEN.findall(text)
        bare = [w for w in words if plain(w) not in ("the", "of", "and")]
        if bare:
            self._organisation(bare, out)
        title = False
        while len(words) > 1 and plain(words[0]) in _TITLES and not (words[0].isupper() and len(words[0]) == 1):
            words, title = words[1:], True
        if not words:
            return []
        if "," in text:
            left, _, right = text.partition(",")
            surname, given = _TOKEN.findall(left), _TOKEN.findall(right)
            if surname and given:
                self._person(given, surname[-1], out)
        elif len(words) == 1:
            w = words[0]
            if title:
                self._person([], w, out)
            else:
                self._person([], w, out, cost=1.0)
                if w == w.lower() and len(w) > 4:
                    self._person([w[0]], w[1:], out, cost=0.3)
        elif " " not in text and "." in text:
            self._person([words[0]], words[-1], out, cost=0.3)
        else:
            if len(words[-1]) == 1:
                self._person(words[1:], words[0], out)
            elif len(words[0]) > 2 and words[0].isupper() and not words[-1].isupper():
                self._person(words[1:], words[0], out)
            else:
                self._person(words[:-1], words[-1], out)
                self._person(words[1:], words[0], out, cost=1.0)
        best: dict[str, float] = {}
        for k, c in out.items():
            ref = self.entities[k][0]
            best[ref] = min(best.get(ref, 99.0), c + self.costs[k])
        return list(best.items())


def _read(spellings: DataFrame, forms: DataFrame, nobody: float, block: int) -> DataFrame:
    """(name_text, n, entity_ref, cost): readings of the spellings as variants of forms, cheaper than nobody.

    The forms (ref, note_type, name, cost, same) are sent to the tasks in blocks of at most about `block`.
    """
    blocks = max(1, -(-forms.count() // block))
    found = None
    for b in range(blocks):
        own = forms if blocks == 1 else forms.where(F.pmod(F.xxhash64("ref", "name"), F.lit(blocks)) == b)
        sent = spellings.sparkSession.sparkContext.broadcast(Channel([tuple(r) for r in own.collect()]))

        def read(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for x in batches:
                rows = [(t, n, ref, c) for t, n in zip(x["name_text"], x["n"]) for ref, c in sent.value.likelihoods(t)]
                yield pd.DataFrame(rows, columns=["name_text", "n", "entity_ref", "cost"])

        part = spread(spellings).mapInPandas(read, "name_text string, n bigint, entity_ref string, cost double")
        found = part if found is None else found.unionByName(part)
    return found.where(F.col("cost") < nobody)


def _attributed(readings: DataFrame, nobody: float) -> DataFrame:
    """(name_text, n, entity_ref, posterior): each spelling's entity of maximum posterior, where it outweighs nobody.

    The prior of the entities is how often they are meant, by one expectation step over the likelihoods.
    """
    of = Window.partitionBy("name_text")
    even = readings.withColumn("p", F.exp(-F.col("cost"))).withColumn("p", F.col("p") / (F.sum("p").over(of) + F.exp(F.lit(-nobody))))
    prior = even.groupBy("entity_ref").agg((F.sum(F.col("n") * F.col("p")) + 0.5).alias("prior"))  # one row per entity
    scored = readings.join(prior, "entity_ref").withColumn("w", F.col("prior") * F.exp(-F.col("cost")))
    scored = scored.withColumn("posterior", F.col("w") / F.sum("w").over(of))
    best = scored.groupBy("name_text").agg(F.max_by(F.struct("n", "entity_ref", "posterior"), F.struct("posterior", "entity_ref")).alias("b"))
    return best.select("name_text", "b.*").where("posterior >= 0.5")


def _variants(first: DataFrame, entities: DataFrame, frequent: int) -> DataFrame:
    """Further canonical forms: aliases, and spellings ranked by how often they stand for their entity.

    A spelling is one if it is a name in full (two words or more, no initials), is certainly its entity's
    (posterior 0.9) and occurs at least `frequent` times. Its cost is that of being used instead of the title.
    """
    meant = first.groupBy("entity_ref").agg(F.sum("n").alias("total"))
    full = F.size(F.regexp_extract_all("name", F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))) >= 2
    full &= ~F.col("name").rlike(r"(?U),|\.|@|^\s*\p{L}\s|\s\p{L}\s|\s\p{L}\s*$")
    spelt = first.where(F.col("posterior") >= 0.9).select(F.col("entity_ref").alias("ref"), F.col("name_text").alias("name"), "n")
    alias = entities.select("ref", F.explode("aliases").alias("name")).where(F.trim(F.coalesce("name", F.lit(""))) != "")
    alias = alias.distinct().join(spelt, ["ref", "name"], "left").select("ref", "name", F.coalesce("n", F.lit(0)).alias("n"))
    own = spelt.where(F.col("n") >= frequent).unionByName(alias).where(full).groupBy("ref", "name").agg(F.max("n").alias("n"))
    own = own.join(entities.select("ref", "note_type", "title"), "ref").where(F.lower("name") != F.lower(F.coalesce("title", F.lit(""))))
    own = own.join(meant.withColumnRenamed("entity_ref", "ref"), "ref", "left")
    cost = -F.log((F.col("n") + 0.5) / (F.coalesce("total", F.lit(0)) + 1.0))
    return own.select("ref", "note_type", "name", cost.alias("cost"), F.array().cast("array<string>").alias("same"))


def attribute_names(
    mentions: DataFrame, entities: DataFrame, nobody: float = 9.5, frequent: int = 5, block_entities: int = 100_000
) -> DataFrame:
    """(mention_id, entity_ref, posterior): the entity that each typed name means.

    nobody is the cost of a name that belongs to no entity: a reading that costs more loses to it. frequent is
    the number of occurrences from which a spelling may be a canonical form itself.
    """
    m = mentions.select("mention_id", "name_text").where("mention_id IS NOT NULL AND trim(name_text) <> ''").distinct()
    spellings = cut_lineage(m.groupBy("name_text").agg(F.count("*").alias("n")))
    e = entities.select("ref", "note_type", "title", "aliases").where("ref IS NOT NULL").dropDuplicates(["ref"])
    titles = e.select("ref", "note_type", F.col("title").alias("name"), F.lit(0.0).alias("cost"), F.col("aliases").alias("same"))
    by_title = cut_lineage(_read(spellings, titles, nobody, block_entities))
    variants = cut_lineage(_variants(_attributed(by_title, nobody), e, frequent))
    by_variant = _read(spellings, variants, nobody, block_entities)
    readings = by_title.unionByName(by_variant).groupBy("name_text", "n", "entity_ref").agg(F.min("cost").alias("cost"))
    best = _attributed(cut_lineage(readings), nobody).select("name_text", "entity_ref", "posterior")
    return m.join(best, "name_text").select("mention_id", "entity_ref", "posterior")
