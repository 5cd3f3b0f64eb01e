"""Problem 3: variant spellings of names, by noisy-channel attribution.

A name is read as given name, middle names, surname and suffix (or as the words of an organisation), in any order it may
be typed in; which words are given names is learnt from where they stand, and so are short forms that `nicknames` lacks,
from how often they stand beside one given name with the same surname and place. Spellings that may stand for one another
share a surname up to one typo, so blocks are the surname's one-letter deletions with the given name's initial. Within a block
every spelling looks for the spelling it was most likely typed from: the prior is that spelling's frequency, the
likelihood multiplies the chances of a typo, a short form, an initial, a dropped middle name or suffix, and affiliation and
shared co-authors count as evidence. Each attaches to its maximum a posteriori source, always one that says at least as
much, if any is likelier than a person of its own; what hangs together is one person.

A full given name never attaches to another one, so relatives stay apart; contradicting middle names, suffixes or
places rule an attachment out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkweave.llm.groups import components, within
from inkweave.llm.lookalike import Former, tables
from inkweave.sources.shared import store

# Short forms of given names in common use, beside those of the table `nicknames`.
SHORT_FORMS = {
    "abby": "abigail", "al": "albert", "alec": "alexander", "andy": "andrew", "becky": "rebecca", "bella": "isabella", "bert": "albert", "beth": "elizabeth",
    "bill": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine", "charlie": "charles", "chris": "christopher", "chuck": "charles", "cindy": "cynthia",
    "dave": "david", "deb": "deborah", "debbie": "deborah", "dolly": "dorothy", "dot": "dorothy", "dottie": "dorothy", "ed": "edward", "eddie": "edward", "ellie": "eleanor",
    "franny": "francesca", "frankie": "francesca", "fritz": "frederick", "gabi": "gabriella", "gaby": "gabriella", "greg": "gregory", "hank": "henry", "harry": "henry", "jack": "john",
    "jackie": "jacqueline", "jake": "jacob", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "joe": "joseph", "kathy": "katherine", "katie": "katherine", "katya": "ekaterina",
    "kit": "christopher", "kitty": "katherine", "larry": "lawrence", "leo": "leonardo", "liz": "elizabeth", "lizzie": "elizabeth", "matt": "matthias", "matze": "matthias", "mick": "michael", "nick": "nicholas",
    "pat": "patricia", "paco": "francisco", "pancho": "francisco", "peg": "margaret", "rick": "richard", "rob": "robert", "sue": "susannah", "susie": "susannah", "steve": "stephen", "ted": "edward",
    "tom": "thomas", "tony": "anthony", "topher": "christopher", "tricia": "patricia", "trish": "patricia", "vic": "victoria", "vlad": "vladimir", "volodya": "vladimir", "will": "william", "willy": "william",
}
_TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "sir"}
_SUFFIXES = {"jr", "sr", "ii", "iii", "iv"}
_PARTICLES = {"van", "von", "der", "den", "de", "la", "el", "al", "di", "da", "del", "dos", "bin", "ten", "ter", "zu", "du", "le"}
_KINDS = {"laboratory": "laboratory", "lab": "laboratory", "labs": "laboratory", "centre": "centre", "center": "centre", "ctr": "centre", "institute": "institute", "inst": "institute", "consortium": "consortium", "collaboration": "collaboration", "collab": "collaboration", "group": "group", "grp": "group", "university": "university", "univ": "university", "department": "department", "dept": "department", "network": "network", "society": "society", "committee": "committee", "team": "team", "project": "project", "foundation": "foundation"}
_IDLE = {"the", "of", "for", "f", "and", "in", "a", "on", "to"}
_SPELT = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i"})
_GLUED = re.compile(r"\b[^\W\d_]{2}\b")  # initials without stops or spaces
FEWEST = 3  # spellings in which a word must stand first to be a given name, at any size of the index
MOST_GIVEN = 1_000_000  # given names and short forms sent to the executors, the commonest first: some 50 MB
_LISTED = 1_000  # spellings of one paper whose co-authors are looked up in one part


def fold(s: str) -> str:
    """Lower case, without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower().translate(_SPELT)) if not unicodedata.combining(c))


def near(a: str, b: str, most: int = 1) -> bool:
    """At most `most` letters inserted, left out, changed or swapped with the next."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    two, one = None, list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i] + [0] * len(b)
        for j in range(1, len(b) + 1):
            row[j] = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (a[i - 1] != b[j - 1]))
            if two is not None and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], two[j - 2] + 1)
        if min(row) > most:
            return False
        two, one = one, row
    return one[-1] <= most


def deletions(s: str) -> set[str]:
    """s and s without any one letter: two words one typo apart share one of them."""
    return {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}


def place(affiliation: str | None) -> str:
    """The name behind `University of X`, `X Univ.` or `Department, X University`; empty if there is none."""
    if not affiliation or not affiliation.strip():
        return ""
    last = re.split(r",|;| - ", fold(affiliation))[-1]
    words = [w for w in re.findall(r"[^\W_]+", last) if w not in _KINDS and w not in _IDLE]
    return " ".join(words)


def _words(name: str) -> tuple[list[str], list[str], str, bool]:
    """(words before the comma or all, words after it, suffix, organisation) of a name in its consistent form."""
    if name != name.upper():
        name = _GLUED.sub(lambda m: " ".join(m.group()) if m.group().isupper() and m.group() not in ("II", "IV", "JR", "SR") else m.group(), name)
    raw = fold(name).replace("&", " and ")
    parts = raw.split(",", 1)
    halves = [re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", p) for p in parts]
    both = [w for h in halves for w in h]
    if any(w in _KINDS for w in both) and len(both) > 1:
        return sorted(_KINDS.get(w, w) for w in both if w not in _IDLE), [], "", True
    suffix = ""
    for h in halves:
        for w in [w for w in h if w in _SUFFIXES]:
            if len(both) > 2:
                suffix = w
                h.remove(w)
    halves = [h for h in halves if h]
    if halves and len(halves[0]) > 1 and halves[0][0] in _TITLES:
        halves[0] = halves[0][1:]
    if len(halves) == 2 and halves[1][0] in _TITLES and len(halves[1]) > 1:
        halves[1] = halves[1][1:]
    return (halves[0] if halves else []), (halves[1] if len(halves) > 1 else []), suffix, False


class Given:
    """Words that are given names, with typos and short forms led back to them."""

    def __init__(self, usual: dict[str, int], short: dict[str, str]):
        self.usual, self.short = usual, short
        self.by: dict[str, list[str]] = {}
        for w in usual:
            if len(w) > 3:
                for d in deletions(w):
                    self.by.setdefault(d, []).append(w)
        self.seen: dict[str, str | None] = {}

    def known(self, w: str) -> bool:
        return w in self.usual or w in self.short or self.typo(w) is not None

    def typo(self, w: str) -> str | None:
        """The usual given name that w is one typo away from."""
        if w in self.usual or w in self.short or len(w) < 3:
            return None
        if w not in self.seen:
            found = {u for d in deletions(w) for u in self.by.get(d, ()) if near(w, u)}
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[w] = max(found, key=lambda u: (self.usual[u], u)) if found else None
        return self.seen[w]

    def formal(self, w: str) -> str:
        w = self.typo(w) or w
        return self.short.get(w, w)

    def read(self, before: list[str], after: list[str]) -> tuple[str, list[str], str]:
        """(given, middle names, surname)."""
        if after:
            return after[0], after[1:], " ".join(before)
        if len(before) < 2:
            return "", [], " ".join(before)
        is_given = [len(w) == 1 or self.known(w) for w in before]
        if not is_given[0] or before[0] in _PARTICLES:
            # the surname first, up to the first given name or initial
            at = next((i for i in range(1, len(before)) if is_given[i] and before[i] not in _PARTICLES), 0)
            if at:
                return before[at], before[at + 1 :], " ".join(before[:at])
        end = len(before) - 1
        while end > 1 and before[end - 1] in _PARTICLES:
            end -= 1
        return before[0], before[1:end], " ".join(before[end:])


def _split(index: DataFrame) -> DataFrame:
    """(author_idx, freq, org, before, after, suffix, place) of every row with a number and a name that is not blank."""
    t = tables(index.sparkSession)
    rows = index.where(F.col("author_idx").isNotNull() & (F.length(F.trim("name")) > 0)).select("author_idx", "name", F.coalesce("freq", F.lit(0)).alias("freq"), "affiliation")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        form = Former(t)
        for b in batches:
            w = [_words(form(n)[0]) for n in b["name"]]
            yield pd.DataFrame({"author_idx": b["author_idx"], "freq": b["freq"], "org": [x[3] for x in w], "before": [x[0] for x in w], "after": [x[1] for x in w], "suffix": [x[2] for x in w], "place": [place(form(a)[0] if a else a) for a in b["affiliation"]]})

    return rows.mapInPandas(run, "author_idx bigint, freq bigint, org boolean, before array<string>, after array<string>, suffix string, place string").where("size(before) > 0")


def _given_names(rows: DataFrame, nicknames: DataFrame) -> tuple[dict[str, int], dict[str, str]]:
    """Given names (frequent, and more often in a given name's place than in a surname's) and short forms from the table."""
    people = rows.where("NOT org AND size(before) + size(after) > 1")
    first = people.select(F.when(F.size("after") > 0, F.col("after")[0]).otherwise(F.col("before")[0]).alias("w"), F.lit(1).alias("f"), F.lit(0).alias("l"))
    last = people.select(F.element_at("before", -1).alias("w"), F.lit(0).alias("f"), F.lit(1).alias("l"))
    counts = first.union(last).groupBy("w").agg(F.sum("f").alias("f"), F.sum("l").alias("l"))
    usual = counts.where((F.col("f") >= FEWEST) & (F.expr("f > 2 * l AND length(w) > 1")) & ~F.col("w").isin(*_PARTICLES, *_TITLES, *_SUFFIXES)).orderBy(F.desc("f"), "w").limit(MOST_GIVEN)
    names = {r["w"]: r["f"] for r in usual.collect()}
    # a rare word one typo from a frequent given name is that typo
    common = sorted(names, key=lambda w: -names[w])
    by: dict[str, list[str]] = {}
    for w in common:
        if len(w) > 2 and any(near(w, u) and names[u] > 20 * names[w] for d in deletions(w) for u in by.get(d, ())):
            names.pop(w)
            continue
        for d in deletions(w) if len(w) > 3 else ():
            by.setdefault(d, []).append(w)
    short = dict(SHORT_FORMS)
    short = {k: v for k, v in short.items() if v in names}
    for r in nicknames.where("given IS NOT NULL AND nick IS NOT NULL").select("given", "nick").distinct().orderBy("nick", "given").limit(MOST_GIVEN).collect():
        short[fold(r["nick"])] = fold(r["given"])
    for v in set(short.values()):
        names.setdefault(v, 1)
    return names, {k: v for k, v in short.items() if k != v}


def _read(rows: DataFrame, given: Given) -> DataFrame:
    """rows with the parts of a person's name: given (led back to its formal form), typed (as it stands), how (full, typo, short, initial, none, org), middles, surname."""
    sent = rows.sparkSession.sparkContext.broadcast((given.usual, given.short))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Given(*sent.value)
        for b in batches:
            out = []
            for org, before, after in zip(b["org"], b["before"], b["after"]):
                if org:
                    out.append(("", "", "org", [], " ".join(before)))
                    continue
                first, middle, surname = g.read(list(before), list(after))
                how = "none" if not first else "initial" if len(first) == 1 else "short" if first in g.short else "typo" if g.typo(first) else "full"
                out.append((g.formal(first) if first else "", first, how, [g.formal(m) if len(m) > 1 else m for m in middle], surname))
            parts = pd.DataFrame(out, columns=["given", "typed", "how", "middles", "surname"])
            yield pd.concat([b[["author_idx", "freq", "suffix", "place"]].reset_index(drop=True), parts], axis=1)

    return rows.mapInPandas(run, "author_idx bigint, freq bigint, suffix string, place string, given string, typed string, how string, middles array<string>, surname string")


def _learnt(read: DataFrame, known: dict[str, str]) -> dict[str, str]:
    """Short forms: words beside which one given name stands, with the same surname and place, far more often than a relative's would."""
    each = read.where("how IN ('full', 'typo') AND place <> ''").select("surname", "place", "given").distinct()
    n = each.groupBy("given").agg(F.count("*").alias("n"))
    # at most the given names of one family at one place
    both = each.join(each.withColumnRenamed("given", "formal"), ["surname", "place"]).where("given <> formal").groupBy("given", "formal").agg(F.count("*").alias("both"))
    found = both.join(n, "given").join(n.toDF("formal", "m"), "formal").where("both >= 3 AND both >= 0.4 * n AND m > 2 * n")
    best = found.groupBy("given").agg(F.max_by("formal", F.struct("both", "formal")).alias("formal"), F.max("both").alias("both")).orderBy(F.desc("both"), "given").limit(MOST_GIVEN).collect()
    return {r["given"]: r["formal"] for r in best if r["given"] not in known}


def _keys(surname: str, given: str, typed: str, how: str) -> list[str]:
    if how == "org":
        w = surname.split(" ")
        return ["o:" + surname, *("o:" + " ".join(w[:i] + w[i + 1 :]) for i in range(len(w)) if len(w) > 2)]
    stem = surname.replace(" ", "").replace("'", "").replace("-", "")
    first = {given[:1], typed[:1]} if how == "typo" else {given[:1]}
    return [f"{d}:{g}" for d in (deletions(stem) if len(stem) > 4 else {stem}) for g in first]


def _candidates(read: DataFrame) -> DataFrame:
    """(x, y): spellings that share a block, every pair of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(key=[_keys(*x) for x in zip(b["surname"], b["given"], b["typed"], b["how"])])
            yield b[["author_idx", "key"]].explode("key")

    keyed = store(read.where("surname <> ''").mapInPandas(run, "author_idx bigint, key string"), "blocks")
    return within(keyed, "key", "author_idx").selectExpr("a AS x", "b AS y").distinct()


def _shared(pairs: DataFrame, authors: DataFrame, index: DataFrame, read: DataFrame) -> DataFrame:
    """(x, y, shared): co-authors' surnames that two spellings share, the rarer the heavier (1 for one that is unique). Papers count whole, however many authors they list; the spellings of a long list meet its surnames in parts."""
    papers = authors.where("id IS NOT NULL").select("id", F.explode(F.array_distinct("authors")).alias("name")).distinct()
    listed = papers.join(index.select("author_idx", "name"), "name").join(read.select("author_idx", "surname"), "author_idx").select("id", "author_idx", "surname")
    listed = store(listed, "listed")
    parts = listed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.ceil(F.col("n") / _LISTED).cast("int").alias("parts"))
    asked = pairs.selectExpr("x AS author_idx").union(pairs.selectExpr("y AS author_idx")).distinct()
    mine = listed.join(asked, "author_idx", "left_semi").join(parts, "id").select("id", F.expr("CAST(pmod(xxhash64(author_idx), parts) AS int)").alias("part"), "author_idx", F.col("surname").alias("own"))
    cos = listed.select("id", F.col("surname").alias("co")).distinct().join(parts, "id").select("id", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "co")
    beside = mine.join(cos, ["id", "part"]).where("own <> co").select("author_idx", "co").distinct()
    beside = store(beside, "beside")
    weight = beside.groupBy("co").agg(F.count("*").alias("df")).where("df > 1")
    total = beside.select("author_idx").distinct().count()
    heavy = beside.join(weight, "co").select("author_idx", "co", (1 - F.log("df") / F.log(F.lit(total + 1.0))).alias("w"))
    a = pairs.join(heavy.toDF("x", "co", "w"), "x")
    return a.join(heavy.select(F.col("author_idx").alias("y"), "co"), ["y", "co"]).groupBy("x", "y").agg(F.sum("w").alias("shared"))


def _rank(how: str, middles: list[str], suffix: str) -> int:
    """How much a spelling says."""
    return 8 * (how in ("full", "short", "typo", "org")) + 2 * sum(len(m) > 1 for m in middles) + len(middles) + (suffix != "")


def likelihood(v: dict, c: dict, shared: float) -> float | None:
    """Log of the chance that v was typed for c, with the evidence; None where a part contradicts. c says at least as much as v."""
    score = 0.0
    same_place = bool(v["place"]) and bool(c["place"]) and (near(v["place"], c["place"], 2) if min(len(v["place"]), len(c["place"])) > 5 else v["place"] == c["place"])
    apart = bool(v["place"]) and bool(c["place"]) and not same_place
    if (v["how"] == "org") != (c["how"] == "org"):
        return None
    a, b = v["surname"], c["surname"]
    typos = 0
    if v["how"] == "org":
        x, y = a.split(" "), b.split(" ")
        if len(x) != len(y):
            return None
        left, right = sorted(set(x) - set(y)), sorted(set(y) - set(x))
        if len(left) > 1 or len(left) != len(right) or left and not near(left[0], right[0]):
            return None
        typos += len(left)
        return (-3.0 * typos) + (3 if same_place else -2 if apart else 0) + 1 + shared
    if a != b:
        stem = [s.replace(" ", "").replace("'", "").replace("-", "") for s in (a, b)]
        if stem[0] != stem[1]:
            if not near(*stem):
                return None
            typos += 1
    if v["given"] != c["given"]:
        if v["how"] == "none" or c["how"] == "none":
            return None
        if v["how"] == "initial" or c["how"] == "initial":
            if v["given"][:1] != c["given"][:1]:
                return None
            score -= 2
        elif v["how"] == "typo" and near(v["typed"], c["given"]) or c["how"] == "typo" and near(c["typed"], v["given"]):
            pass  # one typo from either of two given names; counted below
        elif not (v["how"] == "full" and len(v["given"]) > 4 and near(v["given"], c["given"]) and min(v["freq"], c["freq"]) * 4 <= max(v["freq"], c["freq"]) and same_place and not typos):
            return None
        else:
            typos += 1
    elif v["how"] == "initial":
        score -= 1
    typos += (v["how"] == "typo") != (c["how"] == "typo")
    score -= (v["how"] == "short") != (c["how"] == "short")
    score -= 3.0 * typos
    if typos and not same_place and not shared:
        score -= 0.75 * (min(v["freq"], 10) - 1)  # the same slip again and again is a name
    for m, k in zip(v["middles"], c["middles"]):
        if m == k:
            score += 1
        elif len(m) == 1 or len(k) == 1:
            if m[0] != k[0]:
                return None
        elif not near(m, k):
            return None
        else:
            score -= 3
    score -= abs(len(v["middles"]) - len(c["middles"]))
    if v["suffix"] and c["suffix"] and v["suffix"] != c["suffix"]:
        return None
    if v["suffix"] != c["suffix"]:
        score -= 1
    if apart:
        return None
    return score + (4 if same_place else 0) + 2 * min(float(shared), 3.0)


def attachments(read: DataFrame, pairs: DataFrame, shared: DataFrame, least: float = -4.0) -> DataFrame:
    """(author_idx, source): each spelling's most likely source, where one is likely enough."""
    cols = ["freq", "suffix", "place", "given", "typed", "how", "middles", "surname"]
    x = read.select(F.col("author_idx").alias("x"), F.struct(*cols).alias("a"))
    y = read.select(F.col("author_idx").alias("y"), F.struct(*cols).alias("b"))
    both = pairs.join(shared, ["x", "y"], "left").join(x, "x").join(y, "y").select("x", "y", F.coalesce("shared", F.lit(0.0)).alias("shared"), "a", "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for i, j, s, a, b in zip(t["x"], t["y"], t["shared"], t["a"], t["b"]):
                ka = (_rank(a["how"], a["middles"], a["suffix"]), a["freq"], -i)
                kb = (_rank(b["how"], b["middles"], b["suffix"]), b["freq"], -j)
                if ka > kb:
                    i, j, a, b = j, i, b, a
                value = likelihood(a, b, s)
                if value is not None:
                    out.append((i, j, value, value + float(np.log1p(b["freq"])), a["how"] in ("initial", "none"), b["given"]))
            yield pd.DataFrame(out, columns=["author_idx", "source", "likelihood", "posterior", "vague", "given"])

    scored = store(both.mapInPandas(run, "author_idx bigint, source bigint, likelihood double, posterior double, vague boolean, given string"), "scored")
    # an initial that may stand for several given names needs evidence beyond the letter
    w = W.partitionBy("author_idx")
    rivals = F.size(F.collect_set(F.when(F.length("given") > 1, F.col("given"))).over(w))  # given names with one surname and initial
    best = scored.withColumn("rivals", rivals).where((F.col("likelihood") >= least) & (~F.col("vague") | (F.col("rivals") <= 1) | (F.col("likelihood") > 0)))
    return best.groupBy("author_idx").agg(F.max_by("source", F.struct("posterior", F.negative("source"))).alias("source"))


def people(index: DataFrame, authors: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(author_idx, person): every row of index (author_idx, name, freq, affiliation) that is linked to another; person is the smallest number among its spellings.

    Null and blank names are no one's. Null affiliations and names that are in no list of authors leave the evidence out.
    """
    rows = store(_split(index), "split")
    usual, short = _given_names(rows, nicknames)
    read = store(_read(rows, Given(usual, short)), "read")
    if learnt := _learnt(read, short):
        short = {**short, **learnt}
        read = store(_read(rows, Given({k: v for k, v in usual.items() if k not in learnt}, short)), "read")
    pairs = store(_candidates(read), "candidates")
    shared = store(_shared(pairs, authors, index, read), "shared")
    found = store(attachments(read, pairs, shared), "attachments")
    return components(found).toDF("author_idx", "person")


def variants(index: DataFrame, authors: DataFrame, nicknames: DataFrame) -> DataFrame:
    """All pairs (author_idx_a, author_idx_b) of the spellings of one person."""
    who = store(people(index, authors, nicknames), "people")
    return within(who, "person", "author_idx").selectExpr("a AS author_idx_a", "b AS author_idx_b")
