"""One consistent form for texts that look the same.

Code points and short strings that look the same are joined into classes by
union-find, so that equivalence is transitive (a full-width letter, its plain
form and a letter of another alphabet with that shape end up together).  The
representative of a class is its most frequent member in the corpus; a
multi-pattern automaton then rewrites each text greedily, longest match first.

Accents need no patterns: the text is put into canonical decomposition before and
canonical composition after, which also orders stacked accents.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.physical import materialize, spread

#: Letters of other alphabets with the shape of a Latin letter.
SAME_SHAPE = (
    # Cyrillic, small and capital
    "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv ɡg "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԌG ԚQ ԜW ӀI ѴV "
    # Greek
    "οo νv ϳj "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ϲc ͿJ "
    # Armenian, Cherokee-free rest
    "օo ոn սu հh ցg ՕO ՏS "
)

#: Hyphens of about the same length.
HYPHENS = "-‐‑⁃﹣－"

_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0}


def invisible(char: str) -> bool:
    """Format and control characters, variation selectors and fillers; not blanks."""
    code = ord(char)
    if char in "\t\n\v\f\r\x85\x1c\x1d\x1e\x1f":
        return False
    return unicodedata.category(char) in ("Cf", "Cc") or code in _INVISIBLE or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF


def _shape_of(char: str) -> str | None:
    """The string that ``char`` is only another form of (width, joining, blank)."""
    if invisible(char):
        return ""
    if char in "\t\v\f\x1f" or (unicodedata.category(char) == "Zs" and char != " "):
        return " "
    if char in "\x85\x1c\x1d\x1e  ":
        return "\n"
    mapped = unicodedata.decomposition(char)
    if not mapped.startswith("<"):
        return None
    tag, *codes = mapped.split()
    plain = unicodedata.normalize("NFD", "".join(chr(int(c, 16)) for c in codes))
    if tag in ("<wide>", "<narrow>", "<noBreak>"):
        return plain
    if tag in ("<initial>", "<medial>", "<final>", "<isolated>"):
        return plain if " " not in plain else None
    if tag == "<compat>":
        name = unicodedata.name(char, "")
        joined = len(plain) > 1 and ("LIGATURE" in name or "DIGRAPH" in name or unicodedata.category(char) in ("Lu", "Ll", "Lt") or "ROMAN NUMERAL" in name)
        same = char == "µ" or 0x2F00 <= ord(char) <= 0x2FD5 or "ROMAN NUMERAL" in name
        if joined and all(unicodedata.category(c)[0] == "L" for c in plain) or same:
            return plain
    return None


class Classes:
    """Union-find over strings and code points."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: str, y: str) -> None:
        self.up[self.find(x)] = self.find(y)

    def members(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


@functools.cache
def look_alike_classes() -> list[list[str]]:
    """Classes of code points and strings that look the same, from Unicode's data."""
    classes = Classes()
    for code in range(0x110000):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        shape = _shape_of(chr(code))
        if shape is not None and shape != chr(code):
            classes.join(chr(code), shape)
    for pair in SAME_SHAPE.split():
        classes.join(pair[0], pair[1])
    for hyphen in HYPHENS[1:]:
        classes.join(hyphen, "-")
    classes.join("\r\n", "\n")
    classes.join("\r", "\n")
    return classes.members()


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """Rewriting of each class member to its representative, without identities.

    The invisible class goes to the empty string, blanks to the space, line ends
    to the newline.  Else the most frequent member wins; of equally frequent ones
    a single code point, then the lowest.  A string counts as its rarest
    character.
    """

    def weight(x: str) -> tuple:
        return (-min(counts.get(c, 0) for c in x), len(x), x)

    out = {}
    for members in look_alike_classes():
        fixed = next((x for x in ("", " ", "\n") if x in members), None)
        chosen = fixed if fixed is not None else min(members, key=weight)
        out.update({x: chosen for x in members if x != chosen})
    # A representative may itself hold characters of another class (ligatures).
    for x, chosen in out.items():
        if len(chosen) > 1:
            out[x] = "".join(out.get(c, c) for c in chosen)
    return out


def character_counts(df: DataFrame, text: str) -> DataFrame:
    """``code`` and ``n``: how often each code point occurs in the whole column.

    Code points are counted per batch by array, so at most one row for each
    different code point of a partition is shuffled.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in it:
            joined = "".join(x for x in batch.column(0).to_pylist() if x)
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            found = np.bincount(codes)
            total[: len(found)] += found
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["code", "n"])

    counted = spread(df.select(F.col(text).alias("text")).where("text is not null")).mapInArrow(batches, "code long, n long")
    return counted.groupBy("code").agg(F.sum("n").alias("n"))


class Rewriter:
    """Brings texts to their consistent form; built once in each worker.

    Only stretches of non-ASCII characters, with the character before them (which
    an accent may belong to), go through the automaton; finished stretches are
    kept in a bounded memo.  ASCII members of classes are translated apart.
    """

    def __init__(self, rules: dict[str, str], max_entries: int = 200_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for pattern, chosen in rules.items():
            self.automaton.add_word(pattern, (len(pattern), chosen))
        self.automaton.make_automaton()
        plain = {ord(x): chosen for x, chosen in rules.items() if len(x) == 1 and x.isascii()}
        self.controls = {c: chosen for c, chosen in plain.items() if chosen in ("", " ", "\n")}
        self.letters = {c: chosen for c, chosen in plain.items() if c not in self.controls}
        self.control = re.compile("[" + "".join(map(re.escape, map(chr, self.controls))) + "]").sub
        self.has_control = re.compile("[" + "".join(map(re.escape, map(chr, self.controls))) + "]").search
        self.stretch = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+").sub
        self.memo: dict[str, str] = {}
        self.max_entries = max_entries

    def _rewritten(self, found: re.Match) -> str:
        text = found[0]
        known = self.memo.get(text)
        if known is None:
            known = self._greedy(text)
            if len(text) <= 64:
                if len(self.memo) >= self.max_entries:
                    self.memo.clear()
                self.memo[text] = known
        return known

    def _greedy(self, text: str) -> str:
        text = unicodedata.normalize("NFD", text)
        out, done = [], 0
        for end, (length, chosen) in self.automaton.iter_long(text):
            out.append(text[done : end + 1 - length])
            out.append(chosen)
            done = end + 1
        out.append(text[done:])
        return unicodedata.normalize("NFC", "".join(out))

    def __call__(self, text: str) -> str:
        if self.has_control(text):
            text = self.control(lambda m: self.controls[ord(m[0])], text.replace("\r\n", "\n"))
        if not text.isascii():
            text = self.stretch(self._rewritten, text)
        if self.letters:
            text = unicodedata.normalize("NFC", text.translate(self.letters))
        return text


_REWRITERS: dict[int, Rewriter] = {}


def _rewriter(rules: dict[str, str]) -> Rewriter:
    key = hash(frozenset(rules.items()))
    if key not in _REWRITERS:
        _REWRITERS.clear()
        _REWRITERS[key] = Rewriter(rules)
    return _REWRITERS[key]


def learn_rules(df: DataFrame, text: str) -> dict[str, str]:
    """Rewriting rules with representatives by frequency in the whole corpus.

    Only counts of the class members come to the driver, a number bounded by
    Unicode, not by the corpus.
    """
    spark = df.sparkSession
    codes = sorted({ord(c) for members in look_alike_classes() for x in members for c in x})
    wanted = spark.createDataFrame([(c,) for c in codes], "code long")
    counts = character_counts(df, text).join(F.broadcast(wanted), "code").collect()
    return representatives({chr(r["code"]): r["n"] for r in counts})


def normalize_texts(df: DataFrame, key: str, text: str, rules: dict[str, str] | None = None) -> DataFrame:
    """``key`` and ``form``, the consistent form of every text.

    NULL stays NULL, the empty text stays empty, a text of invisible characters
    becomes empty.  Case, accents, digits, superscripts and punctuation stay as
    they are.  Repeated rows stay repeated; further columns are not read.
    """
    rules = learn_rules(df, text) if rules is None else rules

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = _rewriter(rules)
        for batch in it:
            forms = [None if x is None else rewrite(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], names=["key", "form"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("form", T.StringType())])
    return spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(batches, schema).withColumnRenamed("key", key)


def fingerprints(df: DataFrame, key: str, text: str, rules: dict[str, str] | None = None) -> DataFrame:
    """``key``, ``form_id`` and ``text_id``: 128-bit hashes of form and stored text.

    Rows whose text has no visible character are left out.
    """
    rules = learn_rules(df, text) if rules is None else rules

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = _rewriter(rules)

        def short(x: str) -> bytes:
            return hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest()

        for batch in it:
            rows, forms, texts = [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                form = rewrite(value) if value else ""
                if form and not form.isspace():
                    rows.append(i)
                    forms.append(short(form))
                    texts.append(short(value))
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(forms, pa.binary()), pa.array(texts, pa.binary())], names=["key", "form_id", "text_id"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("form_id", T.BinaryType()), T.StructField("text_id", T.BinaryType())])
    return spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(batches, schema).withColumnRenamed("key", key)


#: The rows of a text that very many documents share are joined in so many parts.
SALTS = 16


def same_look_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs ``<key>_a < <key>_b`` whose texts look the same but differ as strings.

    The whole list is the result by definition.  Different texts of one form are
    paired first, each once; then each pair meets the rows that hold its texts, the
    more frequent text in ``SALTS`` parts.  So the work grows with the rows and the
    result, and plain copies beside a variant are not compared with each other.
    NULL keys form no pair; repeated rows give a pair once.
    """
    prints = materialize(fingerprints(df, key, text).withColumnRenamed(key, "key").where("key is not null"), "fingerprints")
    texts = prints.groupBy("form_id", "text_id").agg(F.count("*").alias("n"))
    mixed = texts.groupBy("form_id").agg(F.count("*").alias("texts")).where("texts > 1").select("form_id")
    variants = materialize(texts.join(mixed, "form_id", "left_semi"), "variants")
    often = variants.select("form_id", F.col("text_id").alias("often"), F.col("n").alias("n_often"))
    seldom = variants.select("form_id", F.col("text_id").alias("seldom"), F.col("n").alias("n_seldom"))
    pairs = often.join(seldom, "form_id").where("n_often > n_seldom or (n_often = n_seldom and often > seldom)").select("often", "seldom")
    members = materialize(prints.join(variants.select("text_id"), "text_id", "left_semi").select("text_id", "key"), "members")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    of_often = members.select(F.col("text_id").alias("often"), F.col("key").alias("a"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"))
    of_seldom = members.join(pairs.select(F.col("seldom").alias("text_id")), "text_id", "left_semi").select(F.col("text_id").alias("seldom"), F.col("key").alias("b"), salts)
    found = of_often.join(pairs.select("*", salts), ["often", "salt"]).join(of_seldom, ["seldom", "salt"]).where("a <> b")
    return found.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b")).distinct()
