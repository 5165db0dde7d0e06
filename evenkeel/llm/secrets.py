"""Secret scans with DataFrame functions only: fixed patterns, then sliding-window entropy.

Base spans are the leftmost non-overlapping matches of each fixed pattern; matches
that are too short are dropped.  Offsets count code points and come from splitting the text
at the matches: gaps and matches alternate.

Entropy spans: candidates are runs of 20 or more key characters, without what base spans
cover and without the names (between two of / + =) that hold a placeholder word; each
piece that is left is judged on its own.  Each class of
characters (hex digits, letters and digits with the signs of base 64) has an alphabet,
a window and a least entropy.  The window slides over a candidate one character at a
time; the counts in the window change by one character in and one out, and with them
the sum of c*log2(c), in whole millionths so that the order of additions does not
matter.  A piece whose best window reaches the least entropy is a span, unless an
allow-list pattern matches all of it (where it was cut out, but for signs at its ends).

Null texts are empty texts and have no spans; a text is one row's work, which grows with its
length and with n log n in its spans: places are running sums, and what covers a candidate is found by halving;
repeated rows have equal results; an empty input gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.llm.common import once

#: Fixed patterns: kind -> (pattern, group whose length counts, least length).
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: What a text must have for a kind to be looked for at all.
HINTS = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Character classes: kind -> (alphabet, window, least entropy in bits).
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", 20, 3.0),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.9),
}
LEAST = 20
PLACEHOLDER = r"(?i).*(example|placeholder|changeme|xxxx).*"
#: A name that holds a placeholder word; "-" and "_" are part of it.  It starts at a separator only, so that
#: a long run is not tried from each of its characters.
NAME = r"(?i)(?<![^/+=])[^/+=]*(?:example|placeholder|changeme|xxxx)[^/+=]*"
#: Candidates that are no secrets: words of letters only, numbers, dashes and rules, UUIDs, placeholders.
ALLOWED = [
    r"[A-Za-z]+",
    r"[0-9]+",
    r"[_=+/-]+",
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    PLACEHOLDER,
    r"[A-Za-z]+(?:[-_/][A-Za-z]+)++",  # possessive: no stack for each word of a long run
]
ORDER = [*KINDS, *CLASSES]
MASK = "[SECRET]"
#: Code points of a block of a text that is masked.
BLOCK = 4096


def _step(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """Further columns that are computed once, however often lambdas read them."""
    names = F.struct(*[c.alias(k) for k, c in columns.items()])
    return once(df, names, "_step", *keep).select(*keep, "_step.*")


#: Steps that double: as many of them as an array is long are taken, so the work is n log n at any length.
DOUBLED = [1 << k for k in range(31)]


def _doubling(numbers: Column, join) -> Column:
    """Running results over an array of numbers: ``join`` of each one with all before it."""
    steps = F.filter(F.array(*[F.lit(d) for d in DOUBLED]), lambda d: d < F.size(numbers))
    return F.aggregate(steps, numbers, lambda a, d: F.transform(a, lambda x, i: join(x, F.get(a, i - d))))


def _running_sum(numbers: Column) -> Column:
    return _doubling(numbers, lambda x, y: x + F.coalesce(y, F.lit(0)))


def _running_max(numbers: Column) -> Column:
    return _doubling(numbers, lambda x, y: F.greatest(x, y))  # a null counts for nothing


def _at_most(ordered: Column, value: Column) -> Column:
    """How many numbers of an ascending array are at most ``value``, by halving."""
    steps = F.filter(F.array(*[F.lit(d) for d in reversed(DOUBLED)]), lambda d: d <= F.size(ordered))
    return F.aggregate(steps, F.lit(0), lambda n, d: F.when(F.get(ordered, n + d - 1) <= value, n + d).otherwise(n))


def _positions(df: DataFrame, kinds: list[str], *keep: str) -> DataFrame:
    """From f_<kind> (matches) and g_<kind> (lengths of the gaps) to p_<kind>: where each match starts."""
    found = [f"f_{k}" for k in kinds]
    steps = {
        f"s_{k}": F.zip_with(f"g_{k}", f"f_{k}", lambda g, m: g + F.coalesce(F.length(m), F.lit(0))) for k in kinds
    }
    df = _step(df, *keep, *found, **steps)
    df = _step(df, *keep, *found, **{f"e_{k}": _running_sum(F.col(f"s_{k}")) for k in kinds})
    starts = {f"p_{k}": F.transform(f"f_{k}", _before(F.col(f"e_{k}"))) for k in kinds}
    return _step(df, *keep, *found, **starts)


def _before(ends: Column):
    return lambda m, i: (F.get(ends, i) - F.length(m)).cast("int")


def _looked_for(text: Column, pattern: str, wanted: Column) -> tuple[Column, Column]:
    """Matches, and the lengths of the gaps around them."""
    found = F.when(wanted, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    gaps = F.when(wanted, F.transform(F.split(text, pattern, -1), lambda g: F.length(g)))
    return F.coalesce(found, F.array().cast("array<string>")), F.coalesce(gaps, F.array().cast("array<int>"))


def _span(start: Column, kind: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), kind.alias("kind"), end.alias("end"))


def _base_spans(kind: str) -> Column:
    pattern, group, least = KINDS[kind]
    number = F.lit(ORDER.index(kind))
    spans = F.zip_with(
        f"f_{kind}",
        f"p_{kind}",
        lambda m, p: F.when(
            F.length(F.regexp_extract(m, pattern, group)) >= least, _span(p, number, p + F.length(m))
        ),
    )
    return F.filter(spans, lambda s: s.isNotNull())


def _allowed(candidate: Column) -> Column:
    """Whether all of it is known to be no secret; names with placeholder words are left to ``_named``."""
    return candidate.rlike("^(?:" + "|".join(f"(?:{p})" for p in ALLOWED if p != PLACEHOLDER) + ")$")


def _spared(piece: Column) -> Column:
    """``_allowed`` of a piece; the signs that joined it to what was cut off do not count."""
    inner = F.regexp_replace(piece["found"], "^[_=+/-]+|[_=+/-]+$", "")
    return _allowed(piece["found"]) | (piece["cut"] & ((inner == "") | _allowed(inner)))


def _piece(found: Column, start: Column, cut: Column) -> Column:
    return F.struct(found.alias("found"), start.cast("int").alias("start"), cut.alias("cut"))


def _long_enough(pieces: Column) -> Column:
    return F.filter(pieces, lambda p: F.length(p["found"]) >= LEAST)


def _with_cover(df: DataFrame, *keep: str) -> DataFrame:
    """c_start and c_end: what the spans of ``base`` (one of ``keep``) cover, as disjoint ascending stretches."""
    df = _step(df, *keep, reach=_running_max(F.transform("base", lambda s: s["end"])))
    first = F.filter(
        F.transform("base", lambda s, i: F.when((i == 0) | (F.get("reach", i - 1) < s["start"]), i)), lambda i: i.isNotNull()
    )
    df = _step(df, *keep, "reach", first=first)
    return _step(
        df,
        *keep,
        c_start=F.transform("first", lambda i: F.get("base", i)["start"]),
        c_end=F.transform("first", lambda _, n: F.get("reach", F.coalesce(F.get("first", n + 1), F.size("base")) - 1)),
    )


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _uncovered(candidate: Column) -> Column:
    """Pieces of a candidate that no base span covers."""
    start, end = candidate["start"], candidate["start"] + F.length(candidate["found"])

    def cut(over: Column) -> Column:
        # the gap before each stretch that overlaps the candidate, and the one after the last
        first, last = over["first"], over["last"]
        gap = lambda n: F.struct(
            F.when(n == first, start).otherwise(F.get("c_end", n - 1)).alias("at"),
            F.when(n == last, end).otherwise(F.get("c_start", n)).alias("to"),
        )
        gaps = F.filter(F.transform(F.sequence(first, last), gap), lambda g: g["to"] - g["at"] >= LEAST)
        return F.transform(
            gaps, lambda g: _piece(F.substring(candidate["found"], g["at"] - start + 1, g["to"] - g["at"]), g["at"], F.lit(True))
        )

    # stretches first to last - 1 end after the candidate's start and start before its end
    over = F.struct(_at_most(F.col("c_end"), start).alias("first"), _at_most(F.col("c_start"), end - 1).alias("last"))
    whole = F.array(_piece(candidate["found"], start, F.lit(False)))
    return _let(over, lambda o: F.when(o["first"] < o["last"], cut(o)).otherwise(whole))


def _named(piece: Column) -> Column:
    """What is left of a piece without its names that hold placeholder words."""
    gaps = F.split(piece["found"], NAME, -1)
    names = F.regexp_extract_all(piece["found"], F.lit(NAME), F.lit(0))
    steps = F.zip_with(
        gaps,
        names,
        lambda g, m: F.struct(g.alias("gap"), (F.length(g) + F.coalesce(F.length(m), F.lit(0))).alias("step")),
    )

    def placed(steps: Column) -> Column:
        return _let(
            _running_sum(F.transform(steps, lambda s: s["step"])),
            lambda ends: F.transform(
                steps, lambda s, i: _piece(s["gap"], piece["start"] + F.get(ends, i) - s["step"], F.lit(True))
            ),
        )

    left = _long_enough(_let(steps, placed))
    return F.when(piece["found"].rlike(PLACEHOLDER), left).otherwise(F.array(piece))


def _scaled(count: int) -> int:
    """count * log2(count) in whole millionths."""
    return round(1_000_000 * count * math.log2(count)) if count else 0


def sum_limit(kind: str) -> int:
    """Most sum of scaled c*log2(c) at which a window has the least entropy of its class."""
    _, window, least = CLASSES[kind]
    return math.floor(1_000_000 * window * (math.log2(window) - least))


def _reaches(chars: Column, kind: str) -> Column:
    """Whether a window over ``chars`` has enough entropy.

    ``counts`` are those in the window and ``total`` their sum of scaled c*log2(c).  A
    character outside the alphabet starts the window anew.
    """
    alphabet, window, _ = CLASSES[kind]
    scaled = F.array(*[F.lit(_scaled(c)).cast("long") for c in range(window + 1)])
    zeros = F.array_repeat(F.lit(0), len(alphabet))
    places = F.transform(chars, lambda c: F.instr(F.lit(alphabet), c) - 1)  # -1: outside
    steps = F.transform(
        places, lambda p, i: F.struct(p.alias("into"), F.when(i >= window, F.instr(F.lit(alphabet), F.get(chars, i - window)) - 1).alias("out"))
    )
    start = F.struct(
        zeros.alias("counts"), F.lit(0).alias("filled"), F.lit(0).cast("long").alias("total"), F.lit(1 << 40).cast("long").alias("best")
    )

    def take_out(a, s):
        full = a["filled"] == window
        c = F.get(a["counts"], s["out"])
        total = F.when(full, a["total"] + F.get(scaled, c - 1) - F.get(scaled, c)).otherwise(a["total"])
        return full, total

    def move(a, s):
        full, total = take_out(a, s)
        counts = F.transform(
            a["counts"], lambda x, i: x + (i == s["into"]).cast("int") - (full & (i == s["out"])).cast("int")
        )
        c = F.get(a["counts"], s["into"]) - (full & (s["into"] == s["out"])).cast("int")
        total = total + F.get(scaled, c + 1) - F.get(scaled, c)
        filled = F.least(a["filled"] + 1, F.lit(window))
        best = F.when(filled == window, F.least(a["best"], total)).otherwise(a["best"])
        inside = F.struct(counts.alias("counts"), filled.alias("filled"), total.alias("total"), best.alias("best"))
        outside = F.struct(
            zeros.alias("counts"), F.lit(0).alias("filled"), F.lit(0).cast("long").alias("total"), a["best"].alias("best")
        )
        return F.when(s["into"] >= 0, inside).otherwise(outside)

    return F.aggregate(steps, start, move, lambda a: a["best"] <= sum_limit(kind))


def _entropy_kind(candidate: Column) -> Column:
    """Number of the first class in which the candidate reaches the least entropy, else null."""
    chars = F.split(candidate, "")
    kind = F.lit(None).cast("int")
    for name in reversed(CLASSES):
        kind = F.when(_reaches(chars, name), F.lit(ORDER.index(name))).otherwise(kind)
    return kind


def with_spans(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep``, ``base`` and ``spans``: sorted arrays of (start, kind as a number, end)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    columns = {}
    for kind, (pattern, *_) in KINDS.items():
        columns[f"f_{kind}"], columns[f"g_{kind}"] = _looked_for(t, pattern, t.rlike(HINTS[kind]))
    candidates = F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))
    columns["possible"] = F.exists(candidates, lambda c: ~_allowed(c))
    matched = [k for k in columns if k != "possible"]
    df = _step(df, *keep, text, **columns)
    found, gaps = _looked_for(t, CANDIDATE, F.col("possible"))
    df = _step(df, *keep, *matched, f_candidate=found, g_candidate=gaps)
    df = _positions(df, [*KINDS, "candidate"], *keep)
    placed = F.zip_with("f_candidate", "p_candidate", lambda m, p: F.struct(m.alias("found"), p.alias("start")))
    base = F.array_sort(F.concat(*[_base_spans(k) for k in KINDS]))
    df = _step(df, *keep, base=base, placed=F.filter(placed, lambda c: ~_allowed(c["found"])))
    df = _with_cover(df, *keep, "base", "placed")
    df = _step(df, *keep, "base", pieces=F.flatten(F.transform("placed", _uncovered)))
    df = _step(df, *keep, "base", pieces=F.flatten(F.transform("pieces", _named)))
    df = _step(df, *keep, "base", clear=F.filter("pieces", lambda p: ~_spared(p)))
    judged = F.transform(
        "clear", lambda c: _span(c["start"], _entropy_kind(c["found"]), c["start"] + F.length(c["found"]))
    )
    df = _step(df, *keep, "base", judged=judged)
    added = F.filter("judged", lambda s: s["kind"].isNotNull())
    return _step(df, *keep, "base", spans=F.array_sort(F.concat("base", added)))


def as_text(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in ORDER])
    parts = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(parts, ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == ORDER.index(kind))).cast("long")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base and spans."""
    found = with_spans(docs.select("doc_id", "text"), "text", "doc_id")
    return found.select("doc_id", *[_count(k).alias(f"n_{k}") for k in KINDS], "base", "spans")


def _blocks(text: Column) -> Column:
    """A text in blocks of ``BLOCK`` code points: a place in it is then found without a walk from its start."""
    numbers = F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK).cast("int"))
    return F.when(F.size("spans") > 0, F.transform(numbers, lambda n: F.substring(text, n * BLOCK + 1, F.lit(BLOCK))))


def _between(first: Column, last: Column) -> Column:
    """The text from ``first`` up to ``last``, out of the blocks that hold it."""
    block = F.floor(first / BLOCK).cast("int")
    count = F.floor(last / BLOCK).cast("int") - block + 1
    return F.substring(F.array_join(F.slice("blocks", block + 1, count), ""), first - block * BLOCK + 1, last - first)


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by a mark; overlapping or touching spans are one."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    found = with_spans(rows, "_text", "_row", "_text")
    found = _step(found, "_row", "_text", "spans", blocks=_blocks(F.col("_text")))
    found = _with_cover(found.withColumn("base", F.col("spans")), "_row", "_text", "spans", "blocks", "base")
    # touching stretches are one mark
    kept_text = F.transform(
        F.sequence(F.lit(0), F.size("c_start")),
        lambda n: _between(
            F.when(n == 0, F.lit(0)).otherwise(F.get("c_end", n - 1)), F.coalesce(F.get("c_start", n), F.length("_text"))
        ),
    )
    masked = F.when(F.size("spans") > 0, F.array_join(kept_text, MASK)).otherwise(F.col("_text"))
    found = once(found, masked, "_masked", "_row", "spans")
    kept = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    kept["text"] = F.col("_masked").alias("text")
    if "n_chars" in kept:
        kept["n_chars"] = (
            F.when(F.size("spans") > 0, F.length("_masked").cast("long")).otherwise(F.col("_row.n_chars")).alias("n_chars")
        )
    return found.select(*kept.values())
