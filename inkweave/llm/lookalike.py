"""Problem 9: one consistent form for texts that look the same.

Each character gets a class of look-alikes from the Unicode confusables data (as shipped with ICU, which Spark brings
along), restricted by rules: letters only resemble letters and signs only signs; capitals only capitals; digits only
their own wide, narrow or styled forms; accents nothing; and two letters in everyday use in one script are never the
same. A token's resolved script set is the intersection of the script sets of its characters; a token whose set is
empty mixes scripts, and a token outside Latin all of whose classes have a Latin member is a whole-script confusable.
Either is respelled in the one script that can write all its classes: the script of a class without a Latin member
when there is one, else Latin. Wide forms, composed accents, unseen characters and kinds of space are folded on the way.

Two texts get the same form exactly if their sequences of classes are the same.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.sources.shared import store

_tables: Tables | None = None
_UNSEEN = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}]|(?![\n\t\r\f\v])\p{Cc}")
_SPACE = regex.compile(r"\p{Zs}")
_SCRIPT_NAMES = ("Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Devanagari", "Bengali", "Georgian", "Hangul", "Cherokee", "Coptic", "Gothic", "Lisu", "Han", "Hiragana", "Katakana", "Thai", "Tamil", "Ethiopic", "Glagolitic", "Deseret")


class Tables:
    """Per character: fold (class spelled in Latin or as a sign), scripts, and spellings of a class in a script."""

    def __init__(self, skeleton: dict[str, str], everyday: set[str]):
        has = {s: regex.compile(rf"\p{{scx={s}}}") for s in _SCRIPT_NAMES}
        self.scripts: dict[str, frozenset[str]] = {}
        classes: dict[tuple, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
        self.fold: dict[str, str] = {}
        signs: dict[str, str] = {}
        for ch in skeleton:
            if ch < "\x7f" and not ch.isalnum() and (skeleton[ch] not in signs or ch == skeleton[ch]):
                signs[skeleton[ch]] = ch
        for ch, skel in skeleton.items():
            kind = unicodedata.category(ch)
            tag = unicodedata.decomposition(ch).split(" ")[0]
            if kind[0] in "LM" and ch > "\x7f" or ch.isalpha():
                self.scripts[ch] = frozenset(s for s, r in has.items() if r.match(ch)) if kind[0] == "L" else frozenset()
            if kind[0] == "M":
                continue
            if kind[0] == "N":
                if tag in ("<wide>", "<narrow>", "<font>"):
                    self.fold[ch] = unicodedata.normalize("NFKC", ch)
            elif kind[0] == "L":
                if tag in ("<wide>", "<narrow>"):
                    self.fold[ch] = unicodedata.normalize("NFKC", ch)
                elif len(skel) == 1 and skel.isalpha() or ch < "\x7f":
                    for s in self.scripts[ch] or ("",):
                        classes[skel, kind == "Lu"][s].append(ch)
                elif ch not in everyday and skel.isalpha() and all(x < "\x7f" for x in skel):
                    self.fold[ch] = skel.replace("rn", "m") if skel == "rn" else skel
            elif skel in signs:
                if signs[skel] != ch and ch > "\x7f":
                    self.fold[ch] = signs[skel]
            elif skel != ch and not any(x.isalnum() for x in skel) and ch > "\x7f":
                self.fold[ch] = skel
        self.spell: dict[str, dict[str, str]] = defaultdict(dict)
        self.only: dict[str, frozenset[str]] = {}
        for (skel, upper), members in classes.items():
            lead, loose = {}, []
            for s, chars in members.items():
                usual = [c for c in chars if c in everyday]
                lead[s] = skel if skel in usual else min(usual or chars)
                loose += [c for c in chars if c not in everyday or c == lead[s]]
                if lead[s] not in everyday and s == "Latin" and len(members) > 1 and not (skel < "\x7f"):
                    del lead[s]
            to = lead.get("Latin") or min(lead.values())
            if upper and skel == "l":
                to = "I"
            for c in loose:
                if c != to and c > "\x7f":
                    self.fold[c] = to
            for s, c in lead.items():
                if s not in ("Latin", "") and c > "\x7f":
                    self.spell[s][to] = c
        for ch, found in self.scripts.items():
            to = self.fold.get(ch, ch)
            if found and "Latin" not in found and "Latin" not in self.scripts.get(to[0], frozenset(["Latin"])):
                self.only[to] = self.only.get(to, frozenset()) | found


def tables(spark: SparkSession) -> Tables:
    """Built once per session on the driver, from rules: a few thousand entries, as many whatever the data."""
    global _tables
    if _tables is None:
        spoof = spark._jvm.com.ibm.icu.text.SpoofChecker
        skip = ((0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0xD800, 0xF8FF))
        chars = [chr(c) for c in range(0x21, 0x1FB00) if not any(a <= c <= b for a, b in skip) and unicodedata.category(chr(c))[0] in "LNPS"]
        skeletons = spoof.Builder().build().getSkeleton("\x01".join(chars)).split("\x01")
        usual = spoof.RECOMMENDED
        everyday = {chr(c) for i in range(usual.getRangeCount()) for c in range(usual.getRangeStart(i), usual.getRangeEnd(i) + 1)}
        _tables = Tables(dict(zip(chars, skeletons)), everyday)
    return _tables


class Former:
    """text -> (form, tokens that mix scripts, tokens that are whole-script confusables); tokens are remembered."""

    def __init__(self, t: Tables):
        self.t, self.seen, self.plain = t, {}, {}
        self.word = re.compile(r"[\w\x80-\U0010ffff]+")
        self.control = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")

    def _word(self, m: re.Match) -> str:
        t = self.t
        chars = unicodedata.normalize("NFD", m.group())
        common: frozenset[str] | None = None
        for c in chars:
            if s := t.scripts.get(c):
                common = s if common is None else common & s
        folded = [x for c in chars for x in unicodedata.normalize("NFD", t.fold.get(c, c))]
        only: frozenset[str] | None = None
        for c in folded:
            if s := t.only.get(c):
                only = s if only is None else only & s
        spelled = False
        for script in sorted(only or ()):
            spell = t.spell.get(script, {})
            if all(c in spell or script in t.scripts.get(c, (script,)) or not t.scripts[c] for c in folded):
                folded, spelled = [spell.get(c, c) for c in folded], True
                break
        self.mixed += common is not None and not common
        self.whole += bool(common) and "Latin" not in common and not spelled
        return "".join(folded)

    def _token(self, token: str) -> tuple[str, int, int]:
        self.mixed = self.whole = 0
        token = "".join(self.t.fold.get(c, c) if unicodedata.category(c)[0] in "PS" else c for c in token)
        return unicodedata.normalize("NFC", self.word.sub(self._word, token)), self.mixed, self.whole

    def __call__(self, text: str) -> tuple[str, int, int]:
        if text.isascii():
            return self.control.sub("", text), 0, 0
        text = unicodedata.normalize("NFC", text)
        for c in set(text):
            to = self.plain.get(c)
            if to is None:
                to = self.plain[c] = " " if _SPACE.match(c) else "" if _UNSEEN.match(c) else c
            if to != c:
                text = text.replace(c, to)
        mixed = whole = 0
        lines = text.split("\n")
        for i, line in enumerate(lines):
            if line.isascii():
                continue
            tokens = line.split(" ")
            for j, w in enumerate(tokens):
                if w.isascii():
                    continue
                found = self.seen.get(w)
                if found is None:
                    if len(self.seen) > 200_000:
                        self.seen.clear()
                    found = self.seen[w] = self._token(w)
                tokens[j] = found[0]
                mixed += found[1]
                whole += found[2]
            lines[i] = " ".join(tokens)
        return "\n".join(lines), mixed, whole


def consistent(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of df: the columns of keep, form, mixed and whole (tokens of either kind). A null text has a null form, an empty one an empty form."""
    t = tables(df.sparkSession)
    rows = df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text") + ", form string, mixed int, whole int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        form = Former(t)
        for b in batches:
            found = [(None, 0, 0) if x is None else form(x) for x in b.pop("__text")]
            b["form"], b["mixed"], b["whole"] = zip(*found) if found else ([], [], [])
            yield b

    return rows.mapInPandas(run, schema)


def _keys(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, hash of the stored text and hash of its form, for non-empty texts; ids delivered again appear once."""
    t = tables(df.sparkSession)
    rows = df.where(F.col(id_col).isNotNull() & (F.length(text) > 0)).select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        form = Former(t)
        digest = lambda x: hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for b in batches:
            forms = [form(x)[0] for x in b["text"]]
            yield pd.DataFrame({"id": b["id"], "stored": [digest(x) for x in b["text"]], "form": [digest(x) for x in forms]})

    return rows.mapInPandas(run, "id bigint, stored binary, form binary")


def lookalikes(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of non-empty texts with one form but different stored characters.

    Only ids and two 16-byte digests are shuffled. Forms with a single stored spelling are left out before any pairing,
    and the spellings of a form are paired before their documents are, so that copies of one text meet only documents
    stored otherwise, which are the result. Null ids, null and empty texts are no case.
    """
    keys = store(_keys(df, id_col, text), "forms")
    spellings = keys.groupBy("form", "stored").agg(F.lit(1).alias("x")).drop("x")
    several = spellings.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    odd = store(keys.join(several, "form").distinct(), "lookalikes")
    kinds = odd.select("form", "stored").distinct()
    pairs = kinds.alias("a").join(kinds.withColumnRenamed("stored", "other").alias("b"), "form").where("stored < other")
    a = odd.select("form", "stored", F.col("id").alias("id_x"))
    b = odd.select("form", F.col("stored").alias("other"), F.col("id").alias("id_y"))
    both = pairs.join(a, ["form", "stored"]).join(b, ["form", "other"]).where("id_x <> id_y")
    return both.select(F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b")).distinct()


def classes(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class_id, spelling_id, spellings) of every document that looks like one stored otherwise: the smallest ids of its form and of its stored spelling, and the number of spellings of the form. One row a document, however large the class."""
    keys = store(_keys(df, id_col, text), "forms").distinct()
    kinds = keys.groupBy("form", "stored").agg(F.min("id").alias("spelling_id"))
    forms = kinds.groupBy("form").agg(F.count("*").alias("spellings"), F.min("spelling_id").alias("class_id")).where("spellings > 1")
    return keys.join(forms, "form").join(kinds, ["form", "stored"]).select("id", "class_id", "spelling_id", "spellings")
