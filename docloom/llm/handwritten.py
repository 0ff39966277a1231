"""Telling hand-written source files from generated, minified, copied and data files.

Evidence comes from Re-Pair grammars over token sequences.

* **Reuse.**  Each file has a grammar of its own over its tokens, in which every
  quoted string and every number is one token.  Rows of literals shrink to a few
  rules, so data files are told by their reuse and their share of literals, and
  files that tools write line by line by their reuse.
* **Literals that no rule shortens.**  Long words that occur once in a file; where
  they make up most of it, it is a blob.
* **Rules shared across repositories.**  Long rules (every run of so many tokens of
  every file) and the short rules of claims (the phrase by which a tool marks its
  output, or the project that a copy names) are counted over the repositories that
  use them, by the hash of what a rule expands to, which is the same in every
  partition and batch.  Long rules, one for nearly every token, are shuffled in
  packed blocks.

Without this evidence nothing is found.  Exact checks follow where hand-written
files compress as well as others: the alphabet of blobs, keys and certificates aside;
the kind of file of minified and generated ones, since hand-written files of many
similar functions compress like them; and for copies that the project named is not
the repository itself.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.grammar import BASE, repair, tokenize
from docloom.operators.physical import materialize, sized_broadcast, spread

_CLAIM_TOKENS = re.compile(r"\d+(?:\.\d+)*|[^\W\d]+|[^\s\w]").findall
_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|--|;|<!--|%|REM\b|@rem\b|\"\"\"|''')", re.I)

#: How tools mark the files that they write, in several languages.
_NOTICE = re.compile(
    r"""^\W*(?:code\ generated\ (?:by|from)|generated\ (?:from|by|with|using)\b|this\ (?:file|code)\ (?:is|was|has\ been)\ (?:auto\w*[ -]?)?generated
    |(?:<\s*)?auto-?\s?generated\b|@generated\b|do\ not\ (?:edit|modify|change|make\ changes)\b
    |(?:diese\ datei\ wurde\ )?(?:automatisch|maschinell)\ (?:erzeugt|generiert|erstellt)|(?:ce\ )?(?:fichier|code)\ (?:est|a\ été)\ (?:automatiquement\ )?(?:produit|généré)
    |(?:este\ )?(?:archivo|fichero|código|arquivo)\ (?:fue\ |es\ |foi\ |é\ )?(?:generado|gerado)|(?:generado|gerado)\ (?:automáticamente|automaticamente|por\b)
    |(?:questo\ )?file\ (?:è\ )?(?:stato\ )?generato|(?:этот\ )?файл\ (?:создан|сгенерирован)|сгенерировано|.{0,12}自动生成|.{0,12}自動生成)""",
    re.I | re.X,
)
_NOT_NOTICE = re.compile(r"\bnot generated\b|(?:written|maintained|kept|sorted) by hand|hand-?written|\bretired\b|edit freely", re.I)

_PROJECT = r"(?:(?:https?://)?(?:[\w-]+\.)+[a-z]+/)?([\w.-]+/[\w.-]*[\w-])"
#: How copies name the project that they come from.
_ORIGIN = re.compile(
    rf"^\W*(?:part\ of|upstream:?|(?:copied|vendored|taken|derived|imported|forked|adapted|extracted)\ (?:verbatim\ )?from|origin(?:al|ally\ from)?:?|source:?|[\w.-]+\ v?\d[\w.]*\ -)\s+{_PROJECT}".replace("\\ ", " "),
    re.I,
)
_LICENSOR = re.compile(r"^\W*(?:released|distributed|licensed) under the .{1,40} by the ([\w.-]+) (?:contributors|authors|developers|project)", re.I)

#: Directories of copied third-party code, with what must follow.
_COPY_PATH = re.compile(
    r"(?:^|/)((?:node_modules|bower_components|jspm_packages|site-packages|_vendor|third[_-]party|thirdparty|external|externals|Godeps|Pods)/(?:@?[\w.-]+/)?[\w.-]+)/"
    r"|(?:^|/)(vendor/(?:[\w-]+\.)+[a-z]+/[\w.-]+)/|(?:^|/)(vendor/[\w.-]+/[\w.-]+)/|(?:^|/)(deps/[\w.-]+(?:/[\w.-]+)?)/src/"
)
_IMPORT_PATH = re.compile(r"(?:^|/)src/(?:[\w-]+\.)+[a-z]+/([\w.-]+/[\w.-]+)/")

#: Names of files that tools write.
_TOOL_FILE = re.compile(
    r"(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h)|_pb\.js|(?:^|/)zz_generated[\w.]*\.go|\.deepcopy\.go|[._]generated\.\w+|\.g\.(?:dart|cs)|(?:^|/)(?:package-lock|npm-shrinkwrap|composer|flake)(?:\.lock)?\.json"
    r"|(?:^|/)(?:yarn|poetry|Pipfile|Cargo|Gemfile|composer|pdm|uv|mix|flake)\.lock|(?:^|/)pnpm-lock\.ya?ml|(?:^|/)go\.sum)$",
)
_STAMP = re.compile(r"DeepCopyInto\(out|_descriptor\.FieldDescriptor\(|\"lockfileVersion\"\s*:|^\s+controller-gen[\w./-]*:|^  (?:uid|resourceVersion): |^//# sourceMappingURL=", re.M)
#: Words of which a text with a stamp holds one.
_STAMP_WORDS = ("DeepCopyInto(out", "FieldDescriptor(", "lockfileVersion", "controller-gen", "  uid: ", "resourceVersion: ", "sourceMappingURL=")
_RESOURCE_DUMP = re.compile(r"^kind: CustomResourceDefinition\b", re.M)
_RESOURCE_STAMP = re.compile(r"^\s+(?:controller-gen[\w./-]*: |creationTimestamp: |acceptedNames:)", re.M)

_LONG = re.compile(r"[A-Za-z0-9+/=_-]{60,}")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]+-----.*?(?:-----END [A-Z0-9 ]+-----|\Z)", re.S)
_WEB = re.compile(r"\.(?:js|mjs|cjs|jsx|ts|css|html?|svg|map)$", re.I)


#: Words of at least so many characters count as literals that no rule shortens, if
#: they occur once; a blob has so large a share of them.
LONG_WORD, BLOB_SHARE = 16, 0.45
#: Least reuse and share of literals of tables of data, least reuse of files of tools
#: and of minified files, and share of line ends below which a file may be minified.
TABLE_REUSE, TABLE_LITERALS = 0.87, 0.12
TOOL_REUSE, MINIFIED_REUSE, MINIFIED_LINE_ENDS = 0.4, 0.1, 0.02

#: Long rules that files share: runs of 2 ** RUN_DOUBLINGS tokens.
RUN_DOUBLINGS = 6
#: A file is a copy if it has so many such runs and nearly all lie in several repositories.
LEAST_RUNS = 8
COPIED_SHARE = 0.95
#: The runs are counted in parts of the space of their hashes, one for so many
#: characters of all files, and packed for so many runs at a time.
PART_CHARACTERS = 12_000_000
RUNS_TOGETHER = 2_000_000
#: Packed files are numbered by two bytes.
FILES_TOGETHER = 1 << 16
#: Blocks of a part beyond so many bytes wait on disk.
SPOOL_BYTES = 64 << 20
#: Wide runs are handed on in batches of about so many bytes.
WIDE_BYTES = 1 << 20


def _long_rules(hashes: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Of each sequence, the hashes of all its runs of 2 ** RUN_DOUBLINGS tokens."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    run, power, step = hashes, BASE, 1
    with np.errstate(over="ignore"):
        for _ in range(RUN_DOUBLINGS):
            run = run[:-step] * power + run[step:]
            power, step = power * power, 2 * step
        mixed = (run ^ (run >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    at = np.arange(len(mixed))
    at = at[owner[at] == owner[at + step - 1]]
    cuts = np.searchsorted(owner[at], np.arange(1, len(lengths)))
    return [np.unique(x) for x in np.split(mixed[at], cuts)]


@dataclass
class Evidence:
    """What the grammar of one file says."""

    reuse: float
    literals: float  # share of strings and numbers among its tokens
    line_ends: float  # share of line ends among its tokens
    unshortened: float  # share of its characters in long words that occur once
    rules: np.ndarray  # hashes of its long rules


def grammars(texts: list[str], together: int = 1_500_000) -> Iterator[Evidence]:
    """The evidence of each text; texts of about ``together`` characters at a time."""
    group: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        group.append(text)
        held += len(text)
        if held < together and i + 1 < len(texts):
            continue
        n = len(group)
        found = tokenize(group)
        owner = found.owner[found.plain]
        tokens = np.bincount(owner, minlength=n)
        least = np.maximum(tokens, 1)
        reuse = repair(found.shape, tokens).reuse
        literals = np.bincount(owner, found.literal, minlength=n) / least
        line_ends = np.bincount(owner, found.line_end[found.plain], minlength=n) / least
        long = np.flatnonzero(found.size >= LONG_WORD)
        _, which, times = np.unique(found.raw[long] ^ (found.owner[long].astype(np.uint64) * BASE), return_inverse=True, return_counts=True)
        once = long[times[which] == 1]
        unshortened = np.bincount(found.owner[once], found.size[once], minlength=n) / np.maximum([len(t) for t in group], 1)
        rules = _long_rules(found.raw, np.bincount(found.owner, minlength=n))
        yield from map(Evidence, reuse.tolist(), literals.tolist(), line_ends.tolist(), unshortened.tolist(), rules)
        group, held = [], 0


def claims(path: str | None, content: str) -> list[tuple[str, str, str]]:
    """(kind, project, phrase) of each line or path prefix that names an author.

    ``kind`` is ``tool`` or ``copy``; ``project`` is the project or owner named,
    empty where only a directory for copies says so.  ``phrase`` is what a rule
    must share: the mark of the tool, the project, or the directory.
    """
    out = []
    for line in content.split("\n"):
        if not _COMMENT.match(line):
            continue
        notice = _NOTICE.match(line)
        if notice and not _NOT_NOTICE.search(line):
            out.append(("tool", "", notice[0]))
        elif found := _ORIGIN.match(line):
            out.append(("copy", found[1].strip("./"), found[1].strip("./")))
        elif found := _LICENSOR.match(line):
            out.append(("copy", found[1].strip("./"), found[1].strip("./")))
    if any(word in content for word in _STAMP_WORDS):
        out += [("tool", "", phrase.strip()) for phrase in {m[0] for m in _STAMP.finditer(content)}]
    if (dump := _RESOURCE_DUMP.search(content)) and _RESOURCE_STAMP.search(content):
        out.append(("tool", "", dump[0]))
    if path:
        if found := _COPY_PATH.search(path):
            out.append(("copy", "", next(g for g in found.groups() if g)))
        elif found := _IMPORT_PATH.search(path):
            out.append(("copy", found[1], found[1]))
    return out


def phrase_rules(kind: str, phrase: str) -> list[int]:
    """Hashes of the rules of a claim's phrase.

    Of the mark of a tool its runs of two and three tokens (of a single token,
    that one); of a project or directory its beginnings, from the owner on.
    """
    if kind == "copy":
        parts = [x for x in phrase.lower().split("/") if x]
        runs = {tuple(parts[: i + 1]) for i in range(len(parts))}
    else:
        tokens = _CLAIM_TOKENS(re.sub(r"^\W+(?=\w)", "", phrase).lower())
        runs = {tuple(tokens[i : i + k]) for k in (2, 3) for i in range(len(tokens) - k + 1)} or {tuple(tokens)}
    return [int.from_bytes(hashlib.blake2b("\0".join(x).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for x in sorted(runs)]


def foreign(project: str, repo: str | None) -> bool:
    """Is the project or owner named another one than the row's own?"""
    if not project or not repo:
        return True
    project, repo = project.lower(), repo.lower()
    return project != repo and project not in repo.split("/")


def encoded(content: str) -> bool:
    """At least half encoded strings, in lines that are not comments; keys and certificates aside."""
    plain = _PEM.sub("", content)
    body = "\n".join(x for x in plain.split("\n") if x.strip() and not _COMMENT.match(x))
    within = sum(len(x) for x in _LONG.findall(body) if not x.startswith("LS0tLS1CRUdJTi"))
    return within >= 1000 and within >= 0.5 * len(body)


def by_structure(found: Evidence, path: str | None, content: str) -> bool:
    """Does a file's own grammar tell that nobody wrote it by hand?

    Blobs, files of tools and minified files are also asked for their form or kind.
    """
    if found.reuse >= TABLE_REUSE and found.literals >= TABLE_LITERALS:
        return True
    if found.unshortened >= BLOB_SHARE and encoded(content):
        return True
    if found.reuse >= TOOL_REUSE and path and _TOOL_FILE.search(path):
        return True
    return found.reuse >= MINIFIED_REUSE and found.line_ends < MINIFIED_LINE_ENDS and bool(path and _WEB.search(path))


def _repo_id(repo: str | None) -> int:
    """A hash of the repository; 0 if there is none."""
    return 0 if repo is None else int.from_bytes(hashlib.blake2b(repo.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") or 1


def pack(runs: list[np.ndarray], repos: list[str | None], parts: int) -> tuple[list[int], list[tuple[int, bytes]]]:
    """The order in which the files are numbered, and (part, block) of their runs.

    Files of one repository follow each other, so a block needs only the first
    number of each.  Hashes are sorted and written byte by byte, the last bytes of
    all first, so that what they have in common is compressed.
    """
    order = sorted(range(len(runs)), key=lambda i: (repos[i] is not None, repos[i] or ""))
    first = [n for n, i in enumerate(order) if not n or repos[i] != repos[order[n - 1]]]
    ids = np.array([_repo_id(repos[order[n]]) for n in first], "<u8")
    starts = np.array(first, "<u2")
    hashes = np.concatenate([runs[i] for i in order])
    at = np.repeat(np.arange(len(order)), [len(runs[i]) for i in order]).astype("<u2")
    by = np.argsort(hashes)
    hashes, at = hashes[by], at[by]
    cuts = np.searchsorted((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
    blocks = []
    for part in np.flatnonzero(np.diff(cuts)).tolist():
        own, where = hashes[cuts[part] : cuts[part + 1]], at[cuts[part] : cuts[part + 1]]
        used = np.flatnonzero(np.bincount(np.searchsorted(starts, where, "right") - 1, minlength=len(starts)))
        planes = np.ascontiguousarray(own.astype("<u8").view(np.uint8).reshape(-1, 8).T)
        blocks.append((part, np.array([len(used), len(own)], "<u4").tobytes() + starts[used].tobytes() + ids[used].tobytes() + where.tobytes() + planes.tobytes()))
    return order, blocks


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of a block its hash, the number of its file and the hash of its repository."""
    n, runs = np.frombuffer(block, "<u4", 2).tolist()
    starts, ids = np.frombuffer(block, "<u2", n, 8), np.frombuffer(block, "<u8", n, 8 + 2 * n)
    at = np.frombuffer(block, "<u2", runs, 8 + 10 * n)
    planes = np.frombuffer(block, np.uint8, 8 * runs, 8 + 10 * n + 2 * runs).reshape(8, runs)
    return np.ascontiguousarray(planes.T).view("<u8").ravel(), at, ids[np.searchsorted(starts, at, "right") - 1]


class Uses:
    """Counts the repositories of hashes, up to ``least`` of each."""

    def __init__(self, least: int, together: int = 4 * RUNS_TOGETHER) -> None:
        self.least, self.together = least, together
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, hashes: np.ndarray, repos: np.ndarray) -> None:
        known = repos != 0
        self.pairs.append((hashes[known], repos[known]))
        self.held += int(known.sum())
        if self.held > self.together:
            self._fold()
            self.together = max(self.together, 2 * self.held)

    def _fold(self) -> np.ndarray:
        """Keeps each pair once, ``least`` of each hash at most; returns the hashes that have so many."""
        hashes, repos = (np.concatenate(x) for x in zip(*self.pairs)) if self.pairs else (np.zeros(0, np.uint64),) * 2
        by = np.argsort(hashes)
        hashes, repos = hashes[by], repos[by]
        times = self._times(hashes)
        rare = times < self.least
        some, theirs = hashes[~rare], repos[~rare]
        by = np.lexsort((theirs, some))
        some, theirs = some[by], theirs[by]
        new = np.ones(len(some), bool)
        new[1:] = (some[1:] != some[:-1]) | (theirs[1:] != theirs[:-1])
        some, theirs = some[new], theirs[new]
        rank = np.arange(len(some)) - np.searchsorted(some, some)
        kept = rank < self.least
        self.pairs = [(np.concatenate((hashes[rare], some[kept])), np.concatenate((repos[rare], theirs[kept])))]
        self.held = len(self.pairs[0][0])
        return some[rank == self.least - 1]

    @staticmethod
    def _times(ordered: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))
        count = np.diff(np.concatenate((first, [len(ordered)])))
        return np.repeat(count, count)

    def wide(self) -> np.ndarray:
        """The hashes of at least ``least`` repositories, in order."""
        return self._fold()


def _rows(columns: dict[str, pa.Array | list], schema: pa.Schema) -> pa.RecordBatch:
    n = len(columns["kind"])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if isinstance(columns.get(f.name), list) else columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


_REST = "kind string, rules array<bigint>, repo string, part int, pack bigint, number int, runs bigint, block binary"


def _fields(key: pa.DataType) -> pa.Schema:
    return pa.schema([("key", key), ("kind", pa.string()), ("rules", pa.list_(pa.int64())), ("repo", pa.string()), ("part", pa.int32()), ("pack", pa.int64()), ("number", pa.int32()), ("runs", pa.int64()), ("block", pa.binary())])


def evidence(df: DataFrame, key: str, path: str, content: str, repo: str, parts: int) -> DataFrame:
    """What each file's own grammar, form and claims say: ``key, kind, rules, repo, part, pack, number, runs, block``.

    ``structure`` rows name files that are not hand-written by their own grammar.
    ``claim`` rows hold the rules of the phrase of a claim of a tool or another
    project, ``own`` rows those of a claim of the row's own project.  ``runs`` rows
    say how many long rules a file has, and its ``number`` in a ``pack`` of files;
    ``block`` rows hold the long rules of a pack that lie in one part.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packs = (context.partitionId() if context else 0) << 32
        waiting: list[tuple[pa.Array, np.ndarray, str | None]] = []
        held = 0

        def packed(schema: pa.Schema) -> Iterator[pa.RecordBatch]:
            nonlocal packs, held
            order, blocks = pack([w[1] for w in waiting], [w[2] for w in waiting], parts)
            n = len(order)
            yield _rows({
                "key": pa.concat_arrays([waiting[i][0] for i in order]), "kind": ["runs"] * n, "part": [i % parts for i in range(n)], "pack": [packs] * n,
                "number": list(range(n)), "runs": [len(waiting[i][1]) for i in order],
            }, schema)
            for i in range(0, len(blocks), 1000):
                some = blocks[i : i + 1000]
                yield _rows({"kind": ["block"] * len(some), "part": [p for p, _ in some], "pack": [packs] * len(some), "block": [b for _, b in some]}, schema)
            packs, held = packs + 1, 0
            waiting.clear()

        schema = None
        for batch in it:
            schema = _fields(batch.schema.field(0).type)
            paths, contents, repos = (batch.column(i).to_pylist() for i in (1, 2, 3))
            rows, kinds, rules, where = [], [], [], []

            def add(i: int, kind: str, hashes: list[int] | None) -> None:
                rows.append(i), kinds.append(kind), rules.append(hashes), where.append(repos[i])

            some = [i for i, c in enumerate(contents) if c and not c.isspace()]
            for i, found in zip(some, grammars([contents[i] for i in some])):
                if by_structure(found, paths[i], contents[i]):
                    add(i, "structure", None)
                elif len(found.rules) >= LEAST_RUNS:
                    waiting.append((batch.column(0).slice(i, 1), found.rules, repos[i]))
                    held += len(found.rules)
                    if held >= RUNS_TOGETHER or len(waiting) == FILES_TOGETHER:
                        yield from packed(schema)
                for kind, project, phrase in claims(paths[i], contents[i]):
                    other = kind == "tool" or foreign(project, repos[i])
                    add(i, "claim" if other else "own", phrase_rules(kind, phrase))
            yield _rows({"key": batch.column(0).take(pa.array(rows, pa.int64())), "kind": kinds, "rules": rules, "repo": where, "part": [i % parts for i in rows]}, schema)
        if waiting:
            yield from packed(schema)

    kind = df.schema[key].dataType.simpleString()
    files = df.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(content).alias("content"), F.col(repo).alias("repo"))
    return spread(files).mapInArrow(batches, f"key {kind}, {_REST}")


def counted(rows: DataFrame, parts: int, min_repositories: int) -> DataFrame:
    """``rows`` with ``wide`` rows for ``block`` rows: by pack, the numbers of the files of each wide run.

    A run is wide if files of at least ``min_repositories`` repositories use it.
    All uses of a run lie in one part, so each task counts its own.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses, packs, schema = Uses(min_repositories), [], None
        with tempfile.SpooledTemporaryFile(SPOOL_BYTES) as spool:
            for batch in it:
                schema = schema or _fields(batch.schema.field(0).type)
                is_block = np.array([k == "block" for k in batch.column(1).to_pylist()], bool)
                rest = batch.filter(pa.array(~is_block))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(rest.columns, schema)], schema=schema)
                for i in np.flatnonzero(is_block).tolist():
                    block = batch.column(8)[i].as_py()
                    hashes, _, repos = unpack(block)
                    uses.add(hashes, repos)
                    spool.write(block)
                    packs.append((batch.column(5)[i].as_py(), len(block)))
            wide = uses.wide()
            del uses
            spool.seek(0)
            found, held = [], 0
            for n, (pack, size) in enumerate(packs if len(wide) else [], 1):
                hashes, at, _ = unpack(spool.read(size))
                hit = wide[np.minimum(np.searchsorted(wide, hashes), len(wide) - 1)] == hashes
                if hit.any():
                    found.append((pack, np.sort(at[hit]).tobytes()))
                    held += len(found[-1][1])
                if found and (held > WIDE_BYTES or n == len(packs)):
                    yield _rows({"kind": ["wide"] * len(found), "pack": [p for p, _ in found], "block": [b for _, b in found]}, schema)
                    found, held = [], 0

    kind = rows.schema["key"].dataType.simpleString()
    return rows.repartitionById(parts, F.col("part")).mapInArrow(batches, f"key {kind}, {_REST}")


def shared_rules(seen: DataFrame, kinds: str, min_repositories: int) -> DataFrame:
    """``rule``: the rules that files of at least ``min_repositories`` repositories use."""
    uses = seen.where(f"kind in ({kinds}) and repo is not null").select("repo", F.explode("rules").alias("rule"))
    return uses.distinct().groupBy("rule").agg(F.count("*").alias("n")).where(F.col("n") >= min_repositories).select("rule")


def by_claim(seen: DataFrame, min_repositories: int) -> DataFrame:
    """Keys of the files with a claim whose phrase holds a rule of several repositories."""
    rules = sized_broadcast(materialize(shared_rules(seen, "'claim', 'own'", min_repositories), "rules"), 500_000)
    return seen.where("kind = 'claim'").select("key", F.explode("rules").alias("rule")).join(rules, "rule", "left_semi").select("key")


def copies(seen: DataFrame) -> DataFrame:
    """Keys of the files of ``seen`` of which nearly all long rules are wide.

    Files with a claim of their own project are left out.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[int, np.ndarray] = {}
        for batch in it:
            for pack, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.bincount(np.frombuffer(block, "<u2"), minlength=FILES_TOGETHER)
                times[pack] = times[pack] + found if pack in times else found
        for pack, found in times.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), pack), pa.int64()), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], names=["pack", "number", "n"])

    wide = seen.where("kind = 'wide'").select("pack", "block").repartition("pack").mapInArrow(batches, "pack bigint, number int, n bigint")
    covered = seen.where("kind = 'runs'").select("key", "pack", "number", "runs").join(wide, ["pack", "number"]).where(F.col("n") >= COPIED_SHARE * F.col("runs"))
    return covered.select("key").join(seen.where("kind = 'own'").select("key"), "key", "left_anti")


def not_handwritten(df: DataFrame, key: str, path: str, content: str, repo: str, min_repositories: int = 2) -> DataFrame:
    """Keys of the files that were not written by hand for their repository.

    A claim (of a tool, or of another project) counts if its phrase holds a rule
    that claims of at least ``min_repositories`` repositories use, wherever they
    lie.  Files without content are never found; files without path or
    repository are judged by what is left (a claim of a project then is foreign).
    A file without claims is a copy if nearly all its long rules lie in more than
    ``min_repositories`` repositories: which of two wrote it, nothing tells.  One
    row per key.
    """
    characters = df.agg(F.coalesce(F.sum(F.length(content)), F.lit(0))).first()[0]
    parts = int(characters // PART_CHARACTERS) + 1
    seen = materialize(counted(evidence(df, key, path, content, repo, parts), parts, min_repositories + 1), "evidence")
    structure = seen.where("kind = 'structure'").select("key")
    found = structure.union(by_claim(seen, min_repositories)).union(copies(seen))
    return found.distinct().withColumnRenamed("key", key)
