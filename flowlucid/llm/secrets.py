"""Secrets by pattern and by a battery of randomness tests, in DataFrame functions only.

Tokens of letters, digits and base64 signs get an alphabet by inferred encoding (digits,
hex, base32, alphanumeric, base64) and three statistics against random draws from it:
chi-squared uniformity of the symbols, the runs test around the middle of the alphabet,
and the serial correlation of neighbours. Their squares add up to a departure from
randomness. Ordinary text of the corpus, its symbols run together and cut in pieces of the
length of a class, all of them, says for each encoding how often what is no secret departs so
little; with these p-values the false-discovery rate of each length class is controlled by the
step-up rule.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import dropping

# The base kinds in order, their patterns and least lengths.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = (*BASE_KINDS, "random")

TOKEN = "[A-Za-z0-9+/_=-]{20,}"
#: Name, pattern of the whole token, symbols in order.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("digits", "^[0-9]+$", _DIGITS),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef"),
    ("base32", "^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("alphanumeric", "^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", "^", _UPPER + _LOWER + _DIGITS + "+/"),
)
LENGTH_CLASSES = (20, 24, 32, 48, 64)
FALSE_DISCOVERIES = 0.05
#: Departures are counted in bins so wide, the last one open.
BIN, LAST_BIN = 0.1, 2000
_GROUP = 256
#: Symbols are places of six bits, held plane by plane: so many symbols to a word.
PLANES, WORD = 6, 8
_PLACES = _UPPER + _LOWER + _DIGITS + "+/"
_SIGN = "[A-Za-z0-9+/_=-]"
#: Long tokens that are no words are not ordinary text.
_NOT_TEXT = f"(?<!{_SIGN})(?![A-Za-z][a-z]+(?!{_SIGN})){_SIGN}{{20,}}"
#: Digits are no sample of text: there its letters stand for them, by place in the alphabet.
_AS_DIGITS = "".join(_PLACES[10 * i // 26] for i in range(26))

Fn = Callable[[Column], Column]


def let(value: Column, fn: Fn) -> Column:
    """``fn(value)`` with ``value`` worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def found_spans(text: Column, pattern: str) -> Column:
    """Array of ``(start, stop, match)`` of the leftmost non-overlapping matches.

    What lies between matches comes from splitting; lengths add up to places, in groups
    of ``_GROUP`` so that many matches don't cost their square.
    """
    def places(parts: Column) -> Column:
        steps = F.transform(parts, lambda p: (F.length(p["piece"]) + F.length(p["match"])).cast("long"))

        def by_group(s: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _GROUP).cast("int")), lambda g: _total(F.slice(s, g * _GROUP + 1, _GROUP)))
            before = let(sums, lambda t: F.transform(t, lambda _, g: _total(F.slice(t, F.lit(1), g))))
            return let(before, lambda b: F.transform(parts, lambda p, i: let(
                F.get(b, F.floor(i / _GROUP).cast("int")) + _total(F.slice(s, F.floor(i / _GROUP).cast("int") * _GROUP + 1, i % _GROUP)) + F.length(p["piece"]),
                lambda at: F.struct(at.alias("start"), (at + F.length(p["match"])).alias("stop"), p["match"].alias("match")),
            )))

        return let(steps, by_group)

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(matches, lambda m: F.when(F.size(m) == 0, F.array().cast("array<struct<start:bigint,stop:bigint,match:string>>")).otherwise(
        let(F.zip_with(m, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), lambda x, y: F.struct(x.alias("match"), y.alias("piece"))), places),
    ))


def base_spans(text: Column) -> Column:
    """Array of ``(start, kind, stop)`` of the base kinds, by start, then kind as listed."""
    long_enough = {
        "assign": lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST["assign"],
        "access": lambda m: F.length(m) >= LEAST["access"],
        "hex": lambda m: F.length(m) >= LEAST["hex"],
    }
    # a run of hex digits is found as a whole, so short ones need not be placed first
    patterns = PATTERNS | {"hex": "[0-9a-f]{16,}", "access": "AKIA[A-Z0-9]{14,}"}

    def of(i: int, kind: str) -> Column:
        kept = F.filter(found_spans(text, patterns[kind]), lambda s: long_enough[kind](s["match"]))
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["stop"].alias("stop")))

    each = [of(i, k) for i, k in enumerate(BASE_KINDS)]
    return F.array_sort(F.concat(*each))


def encoding_of(token: Column) -> Column:
    """The number of the first encoding that a token is in."""
    out = F.lit(None).cast("int")
    for i, (_, pattern, _) in reversed(list(enumerate(ENCODINGS))):
        out = F.when(token.rlike(pattern), i).otherwise(out)
    return out


def departure(token: Column, encoding: Column | None = None) -> Column:
    """How far a token departs from random draws: the sum of three squared standard scores.
    ``encoding`` is the number of its encoding, if not the inferred one."""
    which = encoding_of(token) if encoding is None else encoding
    size = F.get(F.array(*[F.lit(len(symbols)) for _, _, symbols in ENCODINGS]), which)
    alphabet = F.get(F.array(*[F.lit(symbols) for _, _, symbols in ENCODINGS]), which)
    plain = F.translate(F.regexp_replace(F.when(token.rlike("^[0-9A-F]+$"), F.lower(token)).otherwise(token), "=+$", ""), "-_", "+/")

    def scores(v: Column) -> Column:
        n, k = F.length(v["t"]).cast("double"), v["k"].cast("double")
        chars = F.split(v["t"], "")
        squares = _sum(F.transform(F.array_distinct(chars), lambda c: F.pow((F.length(v["t"]) - F.length(F.replace(v["t"], c))).cast("double"), F.lit(2))))
        uniform = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        places = F.transform(chars, lambda c: F.call_function("instr", v["a"], c).cast("double") - 1)

        def ordered(p: Column) -> Column:
            high = F.transform(p, lambda x: F.when(x >= k / 2, 1.0).otherwise(0.0))

            def runs(h: Column) -> Column:
                ones = _sum(h)
                turns = _sum(F.transform(F.sequence(F.lit(1), F.size(h) - 1), lambda i: F.when(F.get(h, i) != F.get(h, i - 1), 1.0).otherwise(0.0)))

                def score(o: Column) -> Column:
                    mean = 2 * o * (n - o) / n + 1
                    var = (mean - 1) * (mean - 2) / (n - 1)
                    return F.when(var > 0, (turns + 1 - mean) / F.sqrt(var)).otherwise(F.lit(10.0))

                return let(ones, score)

            def serial(m: Column) -> Column:
                dev = F.transform(p, lambda x: x - m)

                def ratio(d: Column) -> Column:
                    spread = _sum(F.transform(d, lambda x: x * x))
                    paired = _sum(F.transform(F.sequence(F.lit(1), F.size(d) - 1), lambda i: F.get(d, i) * F.get(d, i - 1)))
                    return F.when(spread > 0, (paired / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(10.0))

                return let(dev, ratio)

            return F.pow(let(high, runs), F.lit(2)) + F.pow(let(_sum(p) / n, serial), F.lit(2))

        return F.pow(F.greatest(uniform, F.lit(0.0)), F.lit(2)) + let(places, ordered)

    return let(F.struct(plain.alias("t"), size.alias("k"), alphabet.alias("a")), lambda v: F.when(F.length(v["t"]) >= 2, scores(v)).otherwise(F.lit(1e9)))


def _binned(value: Column) -> Column:
    return F.least(F.floor(value / BIN), F.lit(LAST_BIN)).cast("int")


def _class_of(size: Column) -> Column:
    step = F.lit(LENGTH_CLASSES[0])
    for c in LENGTH_CLASSES[1:]:
        step = F.when(size >= c, c).otherwise(step)
    return step


def scored_tokens(text: Column, scored: bool = True) -> Column:
    """Array of ``(start, stop, encoding, length_class, bin)`` of all tokens; without ``bin``
    if they are not to be ``scored``."""
    def score(s: Column) -> Column:
        return F.struct(
            s["start"].alias("start"), s["stop"].alias("stop"), encoding_of(s["match"]).alias("encoding"),
            _class_of((s["stop"] - s["start"]).cast("int")).alias("length_class"),
            *([_binned(departure(s["match"])).alias("bin")] if scored else []),
        )

    return F.transform(found_spans(text, TOKEN), score)


def ordinary_streams(text: Column, encodings: Iterable[int]) -> Column:
    """Array of ``(encoding, stream)``: the symbols of the ordinary text that belong to the
    encoding, run together, each written as the base64 sign with its place."""
    def kept(body: Column, symbols: str) -> Column:
        return F.array_join(F.regexp_extract_all(body, F.lit(f"[{symbols}]+"), F.lit(0)), "")

    streams: dict[str, Fn] = {
        "digits": lambda body: F.translate(kept(F.lower(body), "a-z"), _LOWER, _AS_DIGITS),
        "hex": lambda body: F.translate(kept(F.lower(body), "0-9a-f"), _DIGITS + "abcdef", _PLACES[:16]),
        "base32": lambda body: F.translate(kept(F.upper(body), "A-Z2-7"), "234567", "abcdef"),
        "alphanumeric": lambda body: kept(body, "A-Za-z0-9"),
        "base64": lambda body: kept(body, "A-Za-z0-9+/"),
    }
    return let(F.regexp_replace(text, _NOT_TEXT, " "), lambda body: F.array(*[
        F.struct(F.lit(e).alias("encoding"), streams[ENCODINGS[e][0]](body).alias("stream")) for e in encodings
    ]))


def stream_words(stream: Column) -> Column:
    """The words of a stream of base64 signs: byte k of a word holds bit k of the places of
    ``WORD`` symbols, the first symbol in the byte's highest bit."""
    # two symbols of six bits each, their bits dealt to the planes
    dealt = [sum((v >> 6 + k & 1) << 8 * k + 7 | (v >> k & 1) << 8 * k + 6 for k in range(PLANES)) for v in range(4096)]
    table = F.split(F.lit(",".join(map(str, dealt))), ",").cast("array<bigint>")

    def two(w: Column, i: int) -> Column:
        at = F.shiftright(w, 36 - 12 * i).bitwiseAND(F.lit(4095)).cast("int")
        return F.shiftright(F.get(table, at), 2 * i)

    filled = F.concat(stream, F.repeat(F.lit("A"), (WORD - F.length(stream) % WORD) % WORD))
    packed = let(F.unbase64(filled), lambda b: F.transform(
        F.sequence(F.lit(0), (F.length(b) / PLANES).cast("int") - 1),
        lambda j: F.conv(F.hex(F.substr(b, j * PLANES + 1, F.lit(PLANES))), 16, 10).cast("long"),
    ))
    return F.transform(packed, lambda w: reduce(Column.bitwiseOR, [two(w, i) for i in range(4)]))


def _unsigned_shift(value: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, by)


def piece_planes(texts: DataFrame, wanted: list[tuple[int, int]]) -> DataFrame:
    """One row for each piece of ordinary text in the column ``text``, which has no nulls: its
    ``encoding`` and ``length_class`` and the planes ``p0`` to ``p5``, the last symbol in their lowest
    bit. For each wanted encoding and length class a text's stream is cut from its beginning, and
    only what is shorter than a piece is left at its end."""
    encodings = sorted({e for e, _ in wanted})
    lengths = F.create_map(*[x for e in encodings for x in (F.lit(e), F.array(*[F.lit(c) for f, c in wanted if f == e]))])
    streams = texts.select(F.explode(ordinary_streams(F.col("text"), encodings)).alias("s")).select("s.*")
    some = streams.filter(F.length("stream") >= min(c for _, c in wanted)).select(
        "encoding", F.length("stream").alias("size"), F.element_at(lengths, F.col("encoding")).alias("lengths"),
        # no piece reaches beyond the words that follow
        F.concat(stream_words(F.col("stream")), F.array_repeat(F.lit(0).cast("long"), WORD)).alias("words"),
    )
    classes = some.select("encoding", "size", "words", F.explode("lengths").alias("length_class")).filter("size >= length_class")
    last = F.floor(F.col("size") / F.col("length_class")).cast("int") - 1
    places = classes.select("encoding", "words", "length_class", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    at = F.col("i") * F.col("length_class")
    words = [F.coalesce(F.get("words", F.shiftright(at, 3) + j), F.lit(0).cast("long")) for j in range(8)]

    def plane(k: int) -> Column:
        parts = [F.shiftleft(F.shiftright(w, 8 * k).bitwiseAND(F.lit(255).cast("long")), 56 - 8 * j) for j, w in enumerate(words)]
        begun = F.call_function("shiftleft", reduce(Column.bitwiseOR, parts), at.bitwiseAND(F.lit(WORD - 1)))
        return _unsigned_shift(begun, F.lit(64) - F.col("length_class"))

    return places.select("encoding", "length_class", *[plane(k).alias(f"p{k}") for k in range(PLANES)])


def plane_departures(pieces: DataFrame) -> DataFrame:
    """``encoding``, ``length_class`` and ``value``, the ``departure`` of each of the ``piece_planes``.

    All of it follows from whole numbers that are counted bits of planes: the sums of places and of
    their products, and the squared counts of the symbols, which are the mean square of the
    counts' Walsh transform. They are small enough for doubles, which need no look at overflows.
    """
    p = [F.col(f"p{k}") for k in range(PLANES)]
    n = F.col("length_class").cast("double")
    pairs = [(k, j) for k in range(PLANES) for j in range(PLANES)]

    def ones(bits: Column) -> Column:
        return F.bit_count(bits).cast("double")

    def total(numbers: list[Column]) -> Column:
        return reduce(operator.add, numbers)

    walsh = [n - 2.0 * ones(reduce(Column.bitwiseXOR, [p[k] for k in range(PLANES) if m >> k & 1])) for m in range(1, 1 << PLANES)]
    least = {  # bits of the places in the upper half of the alphabet
        "digits": p[3].bitwiseOR(p[2].bitwiseAND(p[1].bitwiseOR(p[0]))), "hex": p[3], "base32": p[4],
        "alphanumeric": p[5].bitwiseOR(reduce(Column.bitwiseAND, p[:5])), "base64": p[5],
    }
    high = F.coalesce(*[F.when(F.col("encoding") == e, least[name]) for e, (name, _, _) in enumerate(ENCODINGS)])
    turned = high.bitwiseXOR(F.shiftrightunsigned(high, 1)).bitwiseAND(_unsigned_shift(F.lit(-1).cast("long"), F.lit(65) - F.col("length_class")))
    counted = pieces.select(
        "encoding",
        # With a lambda Spark makes many small methods of all this instead of one too long to be compiled.
        let(F.col("length_class"), lambda c: c).alias("length_class"),
        (total([n * n, *[x * x for x in walsh]]) / float(1 << PLANES)).alias("squares"),
        total([ones(p[k]) * float(1 << k) for k in range(PLANES)]).alias("sum"),
        total([ones(p[k].bitwiseAND(p[j])) * float(1 << k + j) for k, j in pairs]).alias("square"),
        total([ones(p[k].bitwiseAND(F.shiftrightunsigned(p[j], 1))) * float(1 << k + j) for k, j in pairs]).alias("paired"),
        total([(ones(p[k].bitwiseAND(F.lit(1).cast("long"))) + ones(_unsigned_shift(p[k], F.col("length_class") - 1))) * float(1 << k) for k in range(PLANES)]).alias("ends"),
        ones(high).alias("high"), ones(turned).alias("turns"),
    )
    k = F.get(F.array(*[F.lit(float(len(symbols))) for _, _, symbols in ENCODINGS]), F.col("encoding"))
    uniform = F.greatest((k / n * F.col("squares") - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n), F.lit(0.0))
    mean = 2 * F.col("high") * (n - F.col("high")) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = F.when(var > 0, (F.col("turns") + 1 - mean) / F.sqrt(var)).otherwise(F.lit(10.0))
    s = F.col("sum")
    spread = n * F.col("square") - s * s
    paired = n * n * F.col("paired") - n * s * (2 * s - F.col("ends")) + (n - 1) * s * s
    serial = F.when(spread > 0, (paired / (n * spread) + 1 / n) * F.sqrt(n)).otherwise(F.lit(10.0))
    return counted.select("encoding", "length_class", (uniform * uniform + runs * runs + serial * serial).alias("value"))


def ordinary_pieces(texts: DataFrame, wanted: list[tuple[int, int]]) -> DataFrame:
    """``encoding``, ``length_class`` and ``bin`` of every piece of ordinary text in the column
    ``text``, for each wanted encoding and length class."""
    found = plane_departures(piece_planes(texts, wanted))
    return found.select("encoding", "length_class", _binned(F.col("value")).alias("bin"))


def encoded_cuts(tokens: DataFrame, rate: float = FALSE_DISCOVERIES) -> dict[tuple[int, int], int]:
    """For each encoding and length class the last bin of departures called random.

    ``tokens`` has ``encoding``, ``length_class``, ``bin`` and ``ordinary``. Its rows are
    counted by bin; the rest works on those counts, whose number is fixed. P-values are those
    of the encoding and class, the step-up rule goes over all tokens of the class. Where there
    is no ordinary text there is no evidence and no discovery.
    """
    counts = tokens.groupBy("encoding", "length_class", "bin").agg(F.sum(F.col("ordinary").cast("long")).alias("words"), F.sum((~F.col("ordinary")).cast("long")).alias("tested"))
    own = Window.partitionBy("encoding", "length_class")
    known = counts.withColumn("p", (1 + F.sum("words").over(own.orderBy("bin"))) / (1 + F.sum("words").over(own)))
    whole = Window.partitionBy("length_class")
    allowed = rate * F.sum("tested").over(whole.orderBy("p")) / F.greatest(F.sum("tested").over(whole), F.lit(1))
    level = F.max(F.when((F.col("p") <= F.col("allowed")) & (F.col("bin") < LAST_BIN), F.col("p"))).over(whole)
    passed = known.withColumn("allowed", allowed).withColumn("level", level).filter((F.col("p") <= F.col("level")) & (F.col("bin") < LAST_BIN))
    return {(r.encoding, r.length_class): r["last"] for r in passed.groupBy("encoding", "length_class").agg(F.max("bin").alias("last")).collect()}


def random_cuts(tokens: DataFrame, rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """``encoded_cuts`` by length class, for tokens of one encoding."""
    return {c: last for (_, c), last in encoded_cuts(tokens.withColumn("encoding", F.lit(0)), rate).items()}


def secret_spans(docs: DataFrame, text: str = "text", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """``docs`` plus ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans`` and
    ``secrets``, the array of ``(start, kind, stop)`` behind ``spans``.

    The base kinds are those of the fixed patterns; ``random`` spans are tokens that pass the
    battery and overlap no base span. Places count code points, ends are exclusive. A null
    text is empty and has none; rows are independent but for the corpus-wide cuts, so
    repeated rows and repeated or null ids each give their row; no rows give no rows.
    """
    source = dropping(docs, *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", "secrets")
    whole = F.coalesce(F.col(text), F.lit(""))
    seen = source.select(F.explode(scored_tokens(whole, scored=False)).alias("t")).select("t.encoding", "t.length_class").distinct()
    wanted = sorted((r.encoding, r.length_class) for r in seen.collect())
    cuts = {}
    if wanted:
        tested = source.select(F.explode(scored_tokens(whole)).alias("t")).select("t.encoding", "t.length_class", "t.bin", F.lit(False).alias("ordinary"))
        ordinary = ordinary_pieces(source.select(whole.alias("text")), wanted).withColumn("ordinary", F.lit(True))
        cuts = encoded_cuts(tested.unionByName(ordinary), rate)

    def apart(t: Column, base: Column) -> Column:
        return ~F.exists(base, lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"]))

    def discovered(base: Column) -> Column:
        if not cuts:
            return base
        last = F.create_map(*[F.lit(x) for (e, c), b in cuts.items() for x in (e * 1000 + c, b)])
        chosen = F.filter(scored_tokens(whole), lambda t: (t["bin"] <= F.coalesce(F.element_at(last, t["encoding"] * 1000 + t["length_class"]), F.lit(-1))) & apart(t, base))
        added = F.transform(chosen, lambda t: F.struct(t["start"].alias("start"), F.lit(len(BASE_KINDS)).alias("kind"), t["stop"].alias("stop")))
        return F.array_sort(F.concat(base, added))

    def of_kind(spans: Column, kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    def joined(spans: Column) -> Column:
        kinds = F.array(*[F.lit(k) for k in KINDS])
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))))

    found = let(base_spans(whole), lambda b: F.struct(b.alias("base"), discovered(b).alias("all")))
    result = let(found, lambda f: F.struct(
        *[of_kind(f["base"], i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)],
        F.sha2(joined(f["base"]), 256).alias("base_sha256"), joined(f["all"]).alias("spans"), f["all"].alias("secrets"),
    ))
    return source.withColumn("_found", result).select(*[source[f"`{c}`"] for c in source.columns], "_found.*")


def redacted(docs: DataFrame, text: str = "text", mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mark``; texts without one, and
    null ones, stay as they are."""
    found = secret_spans(docs, text)
    whole = F.col(text)

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        return F.when(s["stop"] <= acc["at"], acc).otherwise(F.struct(
            s["stop"].alias("at"),
            F.concat(acc["out"], F.when(apart, F.concat(F.substring(whole, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))).alias("out"),
        ))

    cleaned = F.aggregate(
        F.col("secrets"), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step,
        lambda acc: F.concat(acc["out"], F.substring(whole, (acc["at"] + 1).cast("int"), F.length(whole))),
    )
    return found.withColumn(text, F.when(F.size("secrets") > 0, cleaned).otherwise(whole)).select(*docs.columns)
