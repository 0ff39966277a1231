"""Re-Pair grammars of many token sequences at once.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new rule
until no pair occurs twice.  Here all sequences of a batch advance together in
rounds of array operations: in each round every pair that is at least as frequent
as the pairs overlapping it is replaced, so a batch needs few rounds, not one per
rule.  A rule is identified by a hash of the tokens it expands to, which is the
same in every batch, partition and repository, however its tokens were paired.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd

BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Grammar:
    """Per sequence: tokens, symbols left, rules, tokens covered; and the rules."""

    tokens: np.ndarray
    left: np.ndarray
    rules: np.ndarray
    covered: np.ndarray
    rule_hash: np.ndarray
    rule_owner: np.ndarray
    rule_length: np.ndarray

    @property
    def reuse(self) -> np.ndarray:
        """Share of each sequence that the grammar saves: 1 - size / tokens."""
        return 1 - (self.left + 2 * self.rules) / np.maximum(self.tokens, 1)


#: Quoted strings within a line.
_STRINGS = re.compile(r"""'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*\"""")

_BLANK, _WORD, _DIGIT, _SIGN = range(4)


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point of the basic plane; of later ones that of the last."""
    out = np.full(0x10000, _SIGN, np.uint8)
    for code in range(0x10000):
        char = chr(code)
        if char == "\n":
            continue  # a token of its own
        if char.isspace() or code == 0:
            out[code] = _BLANK
        elif char.isdecimal():
            out[code] = _DIGIT
        elif char.isalnum() or char == "_":
            out[code] = _WORD
    return out


@dataclass
class Tokens:
    """Tokens of several texts in one row: words, numbers, signs and line ends.

    ``raw`` has the hash of each token.  ``plain`` are the places of the tokens that
    stay when each quoted string and each signed number is one token, ``shape``
    their hashes, equal for all strings and for all numbers, and ``literal`` tells
    which of them are such.
    """

    owner: np.ndarray
    raw: np.ndarray
    size: np.ndarray
    line_end: np.ndarray
    plain: np.ndarray
    shape: np.ndarray
    literal: np.ndarray


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def tokenize(texts: list[str]) -> Tokens:
    """All tokens of ``texts`` by array operations.

    A word is a run of letters, digits and underscores; one that begins with a
    digit is a number (decimal points between digits belong to it).
    """
    code = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[np.minimum(code, 0xFFFF)]
    digit = kind == _DIGIT
    word = digit | (kind == _WORD)
    if len(code) > 2:
        word[1:-1] |= (code[1:-1] == ord(".")) & digit[:-2] & digit[2:]
    held = kind != _BLANK
    begin = held.copy()
    begin[1:] &= ~(word[1:] & word[:-1])
    starts = np.flatnonzero(begin)
    ends_before = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1]
    owner = np.repeat(np.arange(len(texts)), np.diff(np.concatenate((np.searchsorted(starts, ends_before), [len(starts)]))))
    at = np.flatnonzero(held)
    token = np.cumsum(begin)[at] - 1
    within = at - starts[token]
    firsts = np.flatnonzero(begin[at])
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(within.max(initial=0)) + 1, BASE))
        raw = _mixed(np.add.reduceat((code[at].astype(np.uint64) + np.uint64(1)) * powers[within], firsts)) if len(starts) else np.zeros(0, np.uint64)
    size = np.diff(np.concatenate((firsts, [len(at)])))
    number = digit[starts]
    raw[number] = np.uint64(ord("0"))
    sign = np.zeros(len(starts), bool)  # of a number, where no word stands before it
    if len(starts) > 1:
        minus = ((code[starts] == ord("-")) | (code[starts] == ord("+")))[:-1] & number[1:] & (starts[1:] == starts[:-1] + 1)
        sign[:-1] = minus & ~np.concatenate(([False], word[starts[:-2]] | (code[starts[:-2]] == ord(")"))))
    opened, closed = [], []
    for before, text in zip(ends_before.tolist(), texts):
        for m in _STRINGS.finditer(text):
            opened.append(before + m.start())
            closed.append(before + m.end())
    first, after = np.searchsorted(starts, np.array(opened, np.int64)), np.searchsorted(starts, np.array(closed, np.int64))
    depth = np.zeros(len(starts) + 2, np.int64)
    np.add.at(depth, first + 1, 1)
    np.add.at(depth, after, -1)
    quoted = np.cumsum(depth)[: len(starts)] > 0
    literal = number.copy()
    literal[first] = True
    shape = raw.copy()
    shape[first] = np.uint64(ord('"'))
    plain = np.flatnonzero(~quoted & ~sign)
    return Tokens(owner, raw, size, code[starts] == ord("\n"), plain, shape[plain], literal[plain])


def _take_turns(chosen: np.ndarray) -> np.ndarray:
    """Of runs of overlapping choices keep every other one, from the left."""
    at = np.arange(len(chosen))
    first = np.where(chosen & ~np.concatenate(([False], chosen[:-1])), at, -1)
    return chosen & ((at - np.maximum.accumulate(first)) % 2 == 0)


def _chosen(often: np.ndarray) -> np.ndarray:
    """Places of pairs at least as frequent as the pairs that overlap them, every other one of a run."""
    before = np.concatenate(([0], often[:-1]))
    after = np.concatenate((often[1:], [0]))
    return np.flatnonzero(_take_turns((often >= 2) & (often >= before) & (often >= after)))


def repair(hashes: np.ndarray, lengths: np.ndarray, shared: bool = False) -> Grammar:
    """Grammars of the sequences that ``lengths`` cuts out of the token hashes.

    With ``shared`` the sequences of the batch share one grammar (a pair counts
    over all of them), else each has its own.  No pair crosses sequences.  Rounds
    go on until no pair is left that occurs twice without overlapping itself.
    """
    n = len(lengths)
    owner = np.repeat(np.arange(n), lengths)
    symbol, size = hashes.astype(np.uint64), np.ones(len(hashes), np.int64)
    power = np.full(len(hashes), BASE)
    rules = np.zeros(n, np.int64)
    found_hash, found_owner, found_length = [], [], []
    parked_left, parked_covered = np.zeros(n, np.int64), np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        while len(symbol) > 1:
            inner = owner[:-1] == owner[1:]
            pair = symbol[:-1] * power[1:] + symbol[1:]
            key = pair if shared else pair ^ (owner[:-1].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            group, _ = pd.factorize(key)
            counts = np.bincount(group[inner], minlength=int(group.max(initial=0)) + 1)
            often = np.where(inner, counts[group], 0)
            while True:
                at = _chosen(often)
                good = np.bincount(group[at], minlength=len(counts))[group[at]] >= 2
                served = np.zeros(n, bool)
                served[owner[at[good]]] = True
                # A pair that only overlaps itself makes no rule; where a sequence has no
                # other one in this round, its next frequent pairs follow.
                idle = at[~good & ~served[owner[at]]]
                if not len(idle):
                    break
                gone = np.zeros(len(counts), bool)
                gone[group[idle]] = True
                often[gone[group]] = 0
            at = at[good]
            if not len(at):
                break
            _, once = np.unique(group[at], return_index=True)
            makers = at[once]
            rules += np.bincount(owner[makers], minlength=n)
            found_hash.append(pair[makers])
            found_owner.append(owner[makers])
            found_length.append(size[makers] + size[makers + 1])
            symbol[at] = pair[at]
            size[at] += size[at + 1]
            power[at] = power[at] * power[at + 1]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, size, power, owner = symbol[keep], size[keep], power[keep], owner[keep]
            if not shared:  # sequences without a replacement in this round are done
                active = np.zeros(n, bool)
                active[owner[np.searchsorted(np.flatnonzero(keep), at)]] = True
                done = ~active[owner]
                if done.any():
                    parked_left += np.bincount(owner[done], minlength=n)
                    parked_covered += np.bincount(owner[done], size[done] * (size[done] > 1), minlength=n).astype(np.int64)
                    go = ~done
                    symbol, size, power, owner = symbol[go], size[go], power[go], owner[go]
    left = parked_left + np.bincount(owner, minlength=n)
    covered = parked_covered + np.bincount(owner, size * (size > 1), minlength=n).astype(np.int64)
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return Grammar(np.asarray(lengths, np.int64), left, rules, covered, cat(found_hash, np.uint64), cat(found_owner, np.int64), cat(found_length, np.int64))


def ngram_hashes(hashes: np.ndarray, shortest: int, longest: int) -> np.ndarray:
    """Hashes of all runs of ``shortest`` to ``longest`` tokens of one sequence.

    A run has the hash of the rule that expands to the same tokens.
    """
    out, power = [], BASE
    with np.errstate(over="ignore"):
        run = hashes.astype(np.uint64)
        for n in range(2, min(longest, len(hashes)) + 1):
            run = run[:-1] * power + hashes[n - 1 :]
            if n >= shortest:
                out.append(run)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)
