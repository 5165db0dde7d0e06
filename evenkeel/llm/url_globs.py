"""URL rules as globs, all of them simulated at once by one bit-parallel automaton.

A URL is judged in its canonical form, host and path: the host is what stands after the
first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; the path goes on from
there up to ``?``, ``#`` or the end.  In a glob, ``*`` stands for any characters but
``/``, ``**`` for any characters, ``?`` for one character but ``/``, ``[a-z]`` for one
of a set; everything else stands for itself.  A glob fits whole canonical URLs.

Each state of a glob is a bit, and all globs are packed one behind another into words of
64 bits.  A character moves every state at once: bits shift by one where the next symbol
of their glob accepts it, and stay where a star does.  URLs of a batch advance together; a
URL is finished as soon as its only live states are ends that accept whatever follows.  The
last few long URLs of a batch go on alone, with all words as one whole number.

Of the rules that fit a URL the longest one wins, of equally long ones the first.  Null
URLs, empty ones and those without ``://`` have an empty host and path, which no rule of a
host fits.  Repeated rows are judged each, no rows give no rows, and the other
columns of the input, whatever their names, are passed on in one struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: URLs that advance together; their states are an array of so many rows.
TOGETHER = 4096
#: So few URLs go on alone.
ALONE = 8


@dataclass(frozen=True)
class Rule:
    """``name`` and ``verdict`` are reported; any of the globs makes the rule fit; the higher weight wins."""

    name: str
    verdict: str
    globs: tuple[str, ...]
    weight: int


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits a host and all its subdomains, where the path begins with ``path``."""
    safe = "".join(f"[{c}]" if c in "*?[" else c for c in host + path)
    return Rule(host + path, verdict, (f"{safe}**", f"*.{safe}**"), len(host + path))


def glob_rule(verdict: str, glob: str) -> Rule:
    return Rule(glob, verdict, (glob,), len(glob))


# The rules of hosts.
HOST_RULES = [
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
]
# Globs for URLs that no rule of a host fits.
GLOB_RULES = [
    glob_rule("block", "*spam-*/**"),
    glob_rule("block", "*cheap-*/**"),
    glob_rule("block", "**/login*"),
    glob_rule("block", "**.[jp][pn]g"),
]
#: Verdict of a URL that nothing fits.
OTHERWISE = "allow"


def symbols(glob: str) -> list[tuple[str, bool, str]]:
    """(characters, whether they are the excluded ones, star: "", "*" or "**" in front) of each symbol; the last one is the end."""
    out, star, i = [], "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            run = len(glob[i:]) - len(glob[i:].lstrip("*"))
            star, i = ("**" if run > 1 else "*"), i + run
            continue
        end = glob.find("]", i + 2) if c == "[" else -1
        if end > 0:
            inside, chars, k = glob[i + 1 : end], "", 0
            while k < len(inside):
                if k + 2 < len(inside) and inside[k + 1] == "-":
                    chars += "".join(map(chr, range(ord(inside[k]), ord(inside[k + 2]) + 1)))
                    k += 3
                else:
                    chars, k = chars + inside[k], k + 1
            out.append((chars, False, star))
            i = end + 1
        else:
            out.append(("/", True, star) if c == "?" else (c, False, star))
            i += 1
        star = ""
    return [*out, ("", False, star)]


class Automaton:
    """Shift-And masks over all globs of some rules."""

    def __init__(self, rules: list[Rule]):
        order = sorted(range(len(rules)), key=lambda n: -rules[n].weight)
        self.rules = [rules[n] for n in order]
        globs = [(symbols(g), n) for n, rule in enumerate(self.rules) for g in rule.globs]
        named = sorted({ord(c) for parts, _ in globs for chars, _, _ in parts for c in chars} | {ord("/")})
        self.named = np.array(named, np.uint32)  # code points with masks of their own; all others are alike
        bits = sum(len(parts) for parts, _ in globs)
        self.words = max(1, -(-bits // 64))
        kinds = len(named) + 1
        step, stay = [0] * kinds, [0] * kinds
        self.ends, start, whatever, bit = [], 0, 0, 0
        for parts, rule in globs:
            start |= 1 << bit
            for place, (chars, excluded, star) in enumerate(parts):
                here = 1 << (bit + place)
                for kind in range(kinds):
                    c = chr(named[kind]) if kind < len(named) else None
                    if star == "**" or (star == "*" and c != "/"):
                        stay[kind] |= here
                    if place < len(parts) - 1 and ((c in chars) != excluded if c else excluded):
                        step[kind] |= here << 1
            bit += len(parts)
            self.ends.append((bit - 1, rule))
            if parts[-1][2] == "**":
                whatever |= 1 << (bit - 1)
        self.step_whole, self.stay_whole, self.start_whole = step, stay, start
        self.step, self.stay = self._packed(step), self._packed(stay)
        self.start, self.settled = self._packed([start])[0], self._packed([whatever])[0]

    def _packed(self, masks: list[int]) -> np.ndarray:
        data = b"".join(m.to_bytes(8 * self.words, "little") for m in masks)
        return np.frombuffer(data, "<u8").reshape(len(masks), self.words)

    def _alone(self, state: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        d = int.from_bytes(state.tobytes(), "little")
        settled = int.from_bytes(self.settled.tobytes(), "little")
        step, stay = self.step_whole, self.stay_whole
        for k in kinds.tolist():
            d = (d << 1 & step[k]) | (d & stay[k])
            if not d & ~settled:
                break
        return self._packed([d])[0]

    def states(self, urls: list[str]) -> np.ndarray:
        """The words of states that are live at the end of each URL."""
        data = "".join(urls).encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(data, "<u4")
        kind = np.minimum(np.searchsorted(self.named, points), len(self.named) - 1)
        kind = np.where(self.named[kind] == points, kind, len(self.named))
        lengths = np.array([len(u) for u in urls], np.int64)
        first = np.cumsum(lengths) - lengths
        out = np.tile(self.start, (len(urls), 1))
        live, at = np.flatnonzero(lengths > 0), 0
        while len(live) > ALONE:
            d = out[live]
            k = kind[first[live] + at]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            d = (moved & self.step[k]) | (d & self.stay[k])
            out[live] = d
            at += 1
            live = live[(d & ~self.settled).any(1) & (lengths[live] > at)]
        for n in live:
            out[n] = self._alone(out[n], kind[first[n] + at : first[n] + lengths[n]])
        return out

    def best(self, urls: list[str]) -> list[int | None]:
        """For each URL the place in ``rules`` of the rule that wins."""
        states = self.states(urls)
        found = np.full(len(urls), len(self.rules))
        for bit, rule in self.ends:
            hit = (states[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) > 0
            found[hit] = np.minimum(found[hit], rule)
        return [n if n < len(self.rules) else None for n in found.tolist()]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _judge(automata: list[Automaton], otherwise: str):
    @F.arrow_udf("rule string, pattern string, verdict string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hosts, paths in batches:
            urls = [h + p for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
            fits = []
            for a in automata:
                found = [n for k in range(0, len(urls), TOGETHER) for n in a.best(urls[k : k + TOGETHER])]
                fits.append([None if n is None else a.rules[n] for n in found])
            verdicts = [next((r.verdict for r in of_url if r), otherwise) for of_url in zip(*fits)]
            names = [pa.array([r and r.name for r in tier], pa.string()) for tier in fits]
            yield pa.StructArray.from_arrays([*names, pa.array(verdicts, pa.string())], ["rule", "pattern", "verdict"])

    return run


def judge(
    pages: DataFrame, rules: list[Rule] = HOST_RULES, globs: list[Rule] = GLOB_RULES, otherwise: str = OTHERWISE
) -> DataFrame:
    """row (a struct of all columns), host, path, rule, pattern, verdict of each row's ``url``.

    ``rule`` names the winner of ``rules``, ``pattern`` that of ``globs``; null where none fits.
    The verdict is the rule's, else the pattern's, else ``otherwise``.  Only hosts and paths go through Python.
    """
    url = F.col("url").cast("string")
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row")
    known = pages.select(row, host_of(url).alias("host"), path_of(url).alias("path"))
    found = _judge([Automaton(list(rules)), Automaton(list(globs))], otherwise)(F.col("host"), F.col("path"))
    return known.select("row", "host", "path", found.alias("_found")).select("row", "host", "path", "_found.*")


ORACLE = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
judged AS (
  SELECT page_id, host, path,
    CASE WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule,
    CASE WHEN regexp_full_match(host || path, '(?s).*\.[jp][pn]g') THEN '**.[jp][pn]g'
         WHEN regexp_full_match(host || path, '(?s)[^/]*cheap-[^/]*/.*') THEN '*cheap-*/**'
         WHEN regexp_full_match(host || path, '(?s)[^/]*spam-[^/]*/.*') THEN '*spam-*/**'
         WHEN regexp_full_match(host || path, '(?s).*/login[^/]*') THEN '**/login*' END AS pattern
  FROM parts)
SELECT page_id, host, path, rule, pattern,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM judged"""
