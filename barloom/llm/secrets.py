"""Secret scans: fixed patterns plus a randomness test battery, in DataFrame functions only.

Patterns find keys, passwords and hex strings with their places. The battery
looks at other unbroken runs of key characters that mix letters and digits. It
infers an encoding and asks two questions.

* Could the run be uniform over that alphabet? A chi-squared test of the
  letters, a runs test around the middle of the alphabet and a lag-one serial
  correlation are joined by Fisher's rule; a run below ``ALPHA`` is not random.
* Could an ordinary name look as random? The same count of repeated letters, and
  the changes between letters, capitals and digits, are held against fixed rates
  of ordinary names. That p-value is small only where the run is long or mixed
  enough to tell, so short runs need more.

A run that the first question does not reject is reported when a
Benjamini-Hochberg rule on the second rejects that it is ordinary, inside each
class of encoding and length: of the runs reported at most a share ``FDR`` is
ordinary, as far as those rates describe ordinary names.

Places are code points, end exclusive. Nothing here leaves the JVM. Lists are
built by folds over short pieces, so the work grows with the text alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (kind, pattern, group whose length counts, least length).
KINDS = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Where a match long enough is certain to start; rows without it are not searched.
_HINTS = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12}", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
#: Unbroken runs the battery tests: of 12 and more characters, with a letter and a digit.
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{12,}"
#: Share of ordinary names among the runs that the battery reports.
FDR = 0.05
#: A run is not random from this p-value of the three tests down.
ALPHA = 0.01
#: Ordinary names: two characters are the same this often at least (or twice as often as in random
#: ones), and neighbours begin a new word, capital or number this often.
REPEATS, CHANGES = 0.05, 0.15
#: Longest class by length: runs of 2**12 characters and more form one.
_LAST_CLASS = 12
_BINS_PER_DECADE, _LAST_BIN = 50, 1000
_SPAN = "struct<start:int,rank:int,kind:string,stop:int>"
_SPANS = f"array<{_SPAN}>"
_RUN = "struct<start:int,stop:int,token:string>"
#: Entries a fold collects before it starts another list, as each entry copies the list.
_PIECE = 128

# Alphabets of the encodings, the first that fits is inferred; each needs a digit and a letter.
_ENCODINGS = (
    ("hex", "^[0-9a-f]+$|^[0-9A-F]+$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[0-9a-z]+$|^[0-9A-Z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[0-9A-Za-z+/]+$|^[0-9A-Za-z_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut(items: Column) -> Column:
    """An array, not empty, in pieces of ``_PIECE``."""
    return F.transform(F.sequence(F.lit(0), F.size(items) - 1, F.lit(_PIECE)), lambda i: F.slice(items, i + 1, F.lit(_PIECE)))


def _scan(items: Column, kind: str, advance: Callable, keep: Callable, emit: Callable) -> Column:
    """``emit(at, x)`` of the items where ``keep(at, x)``, as ``array<kind>``; ``at`` starts at 0 and goes on by ``advance(at, x)``."""
    nothing = F.array().cast(f"array<{kind}>")

    def step(acc: Column, x: Column) -> Column:
        at, out = acc["at"], acc["out"]
        return F.struct(advance(at, x).alias("at"), F.when(keep(at, x), F.array_append(out, emit(at, x))).otherwise(out).alias("out"))

    def piece(acc: Column, part: Column) -> Column:
        at = F.coalesce(F.get(acc, F.size(acc) - 1)["at"], F.lit(0))
        return F.array_append(acc, F.aggregate(part, F.struct(at.alias("at"), nothing.alias("out")), step))

    def folded(items: Column) -> Column:
        parts = F.aggregate(_cut(items), F.array().cast(f"array<struct<at:int,out:array<{kind}>>>"), piece)
        return F.when(F.size(items) > 0, F.flatten(F.transform(parts, lambda p: p["out"]))).otherwise(nothing)

    return _bound(items, folded)


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Matches with the length of the text before each, as ``array<struct<gap, match, size>>``; the last entry has no match.

    Splitting by the pattern gives the text between the matches, so both arrays
    together give every place.
    """
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = every if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.arrays_zip(F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"), every.alias("match"), F.transform(counted, F.char_length).alias("size"))


def _past(at: Column, x: Column) -> Column:
    return at + x["gap"] + F.coalesce(F.char_length(x["match"]), F.lit(0))


def _places(text: Column, pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """``array<struct<start, rank, kind, stop>>`` of the matches whose group is long enough."""
    span = lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), _past(at, x).alias("stop"))
    return _scan(_matches(text, pattern, group), _SPAN, _past, lambda _at, x: F.coalesce(x["size"] >= least, F.lit(False)), span)


def base_spans(text: Column) -> Column:
    """Matches of the fixed kinds, by start and then kind as listed."""
    none = F.array().cast(_SPANS)
    kinds = [F.when(text.rlike(_HINTS[kind]), _places(text, pattern, group, least, kind, i)).otherwise(none) for i, (kind, pattern, group, least) in enumerate(KINDS)]
    return F.array_sort(F.concat(*kinds))


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal, by the logistic form of Bowling and others (2009)."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * z + F.lit(0.070566) * z * z * z))


def encoding(token: Column) -> Column:
    """The narrowest alphabet a run fits; null without both a digit and a letter."""
    out = F.lit(None).cast("string")
    for name, pattern, _ in reversed(_ENCODINGS):
        out = F.when(token.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(token.rlike("[0-9]") & token.rlike("[A-Za-z]"), out)


def battery(runs: Column) -> Column:
    """Tests an ``array<struct<start, stop, token>>`` and adds ``encoding, length_class, p_random, p_ordinary`` to each run.

    ``p_random`` is small when the run is not uniform over its alphabet: letters
    too uneven, too few or too many runs around the middle letter, or neighbours
    that depend on each other. ``p_ordinary`` is small when an ordinary name
    would repeat more letters or change less between letters, capitals and
    digits. Runs without an inferred encoding are dropped; they are words or
    numbers. Each step below adds fields to the struct, so no expression is
    evaluated twice.
    """

    def also(rows: Column, **fields) -> Column:
        return F.transform(rows, lambda r: _with(r, {k: f(r) for k, f in fields.items()}))

    def _with(r: Column, new: dict[str, Column]) -> Column:
        for k, v in new.items():
            r = r.withField(k, v)
        return r

    def one_case(r: Column) -> Column:
        return F.when(r["encoding"].isin("hex", "base36"), F.lower(r["token"])).otherwise(F.translate(r["token"], "-_", "+/"))

    def alphabet(r: Column) -> Column:
        out = F.lit("")
        for name, _, letters in _ENCODINGS:
            out = F.when(r["encoding"] == name, F.lit(letters)).otherwise(out)
        return out

    def squares(r: Column) -> Column:
        chars = r["chars"]
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.pow(F.size(F.filter(chars, lambda x: x == c)).cast("double"), F.lit(2.0)))

    def runs_p(r: Column) -> Column:
        mu = F.lit(2.0) * r["n1"] * (r["n"] - r["n1"]) / r["n"] + 1
        var = (mu - 1) * (mu - 2) / (r["n"] - 1)
        z = F.abs(r["changes"] + 1 - mu) / F.sqrt(F.greatest(var, F.lit(1e-9)))
        return F.when((r["n1"] > 0) & (r["n1"] < r["n"]) & (var > 0), 2 * _tail(z)).otherwise(F.lit(1e-6))

    def uniform_p(r: Column) -> Column:
        f = r["k"] - 1
        chi2 = r["squares"] * r["k"] / r["n"] - r["n"]
        spread = F.lit(2.0) / (9 * f)
        return _tail((F.pow(F.greatest(chi2, F.lit(0.0)) / f, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))

    def lag(r: Column) -> Column:
        mean = (r["k"] + 1) / 2
        return F.aggregate(r["pairs"], F.lit(0.0), lambda s, p: s + (p["a"] - mean) * (p["b"] - mean))

    def joined(r: Column) -> Column:
        # Fisher: -2 sum(ln p) is chi-squared with six degrees of freedom, whose tail has a closed form
        parts = [F.ln(F.greatest(F.least(r[p], F.lit(1.0)), F.lit(1e-12))) for p in ("p_uniform", "p_runs", "p_serial")]
        x = -(parts[0] + parts[1] + parts[2])
        return F.exp(-x) * (1 + x + x * x / 2)

    def ordinary(r: Column) -> Column:
        # ordered pairs of equal characters, whose mean and variance follow from the rate and 1.4 times its square for triples
        n, rate = r["n"], F.greatest(F.lit(REPEATS), 2 / r["k"])
        mean = n * (n - 1) * rate
        var = 2 * n * (n - 1) * (rate + (2 * (n - 2) * 1.4 - (2 * n - 3)) * rate * rate)
        few = _tail((mean - (r["squares"] - n)) / F.sqrt(var))
        m = r["marks"] - 1
        many = F.when(m > 0, _tail((r["turns"] - m * CHANGES) / F.sqrt(m * (CHANGES * (1 - CHANGES))))).otherwise(1.0)
        x = -F.ln(F.greatest(few, F.lit(1e-15))) - F.ln(F.greatest(many, F.lit(1e-15)))
        return F.exp(-x) * (1 + x)

    kind_of = lambda c: F.when(c.between("0", "9"), 0).when(c.between("A", "Z"), 2).otherwise(1)
    turned = lambda p: (p["a"] != p["b"]) & ~((p["a"] == 2) & (p["b"] == 1))  # noqa: E731 - a capital begins its word
    rows = F.filter(also(runs, encoding=lambda r: encoding(r["token"])), lambda r: r["encoding"].isNotNull())
    rows = also(rows, chars=lambda r: F.split(one_case(r), ""), alphabet=alphabet)
    rows = also(rows, n=lambda r: F.size(r["chars"]).cast("double"), k=lambda r: F.char_length(r["alphabet"]).cast("double"), code=lambda r: F.transform(r["chars"], lambda c: F.position(c, r["alphabet"]).cast("double")))
    rows = also(rows, kinds=lambda r: F.transform(F.split(F.regexp_replace(r["token"], "[-+/_]", ""), ""), kind_of))
    rows = also(rows, steps=lambda r: F.arrays_zip(F.slice(r["kinds"], F.lit(1), F.size(r["kinds"]) - 1).alias("a"), F.slice(r["kinds"], F.lit(2), F.size(r["kinds"]) - 1).alias("b")))
    rows = also(rows, marks=lambda r: F.size(r["kinds"]).cast("double"), turns=lambda r: F.size(F.filter(r["steps"], turned)).cast("double"))
    rows = also(rows, pairs=lambda r: F.arrays_zip(F.slice(r["code"], F.lit(1), F.size(r["code"]) - 1).alias("a"), F.slice(r["code"], F.lit(2), F.size(r["code"]) - 1).alias("b")))
    rows = also(
        rows,
        squares=squares,
        n1=lambda r: F.size(F.filter(r["code"], lambda c: c > r["k"] / 2)).cast("double"),
        changes=lambda r: F.size(F.filter(r["pairs"], lambda p: (p["a"] > r["k"] / 2) != (p["b"] > r["k"] / 2))).cast("double"),
        lag=lag,
    )
    rows = also(rows, p_uniform=uniform_p, p_runs=runs_p, p_serial=lambda r: 2 * _tail(F.abs(r["lag"]) / ((r["k"] * r["k"] - 1) / 12 * F.sqrt(r["n"] - 1))))
    size_class = lambda r: F.least(F.floor(F.log2(r["n"])), F.lit(_LAST_CLASS).cast("long")).cast("int")
    return F.transform(
        rows,
        lambda r: F.struct(
            r["start"].alias("start"), r["stop"].alias("stop"), r["token"].alias("token"), r["encoding"].alias("encoding"), size_class(r).alias("length_class"), joined(r).alias("p_random"), ordinary(r).alias("p_ordinary")
        ),
    )


def open_runs(text: Column, base: Column) -> Column:
    """Runs of key characters that no base match covers, as ``array<struct<start, stop, token>>``; ``base`` is sorted."""
    nothing = F.array().cast(f"array<{_RUN}>")
    mark = len(KINDS)
    item = lambda start, rank, stop, token: F.struct(start.alias("start"), rank.alias("rank"), stop.alias("stop"), token.alias("token"))
    kind = "struct<start:int,rank:int,stop:int,token:string>"
    found = _scan(_matches(text, RUN, 0), kind, _past, lambda _at, x: x["match"].isNotNull(), lambda at, x: item(at + x["gap"], F.lit(mark), _past(at, x), x["match"]))
    known = F.transform(base, lambda b: item(b["start"], b["rank"], b["stop"], F.lit(None).cast("string")))
    # ordered by start, and base matches first, a run is covered when one of the base matches so far ends behind it
    free = _scan(
        F.array_sort(F.concat(known, found)),
        _RUN,
        lambda at, x: F.when(x["rank"] < mark, F.greatest(at, x["stop"])).otherwise(at),
        lambda at, x: (x["rank"] == mark) & (at < x["stop"]),
        lambda _at, x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["token"].alias("token")),
    )
    return F.when(text.rlike(RUN), free).otherwise(nothing)


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * _BINS_PER_DECADE), F.lit(_LAST_BIN).cast("long")).cast("int")


def random_bins(docs: DataFrame, q: float = FDR) -> list[tuple[str, int, int]]:
    """``(encoding, length class, bin)``: the least bin of ``-log10 p_ordinary`` that the step-up rule rejects.

    p-values are counted in bins per class over all distinct runs of the corpus
    that may be random, so the rule needs a table of at most 5 x 13 x 1001
    counts. A bin stands for its largest p-value.
    """
    text = F.col("text")
    runs = docs.where(text.rlike(RUN)).select(F.explode(_bound(base_spans(text), lambda base: battery(open_runs(text, base)))).alias("r")).where(F.col("r.p_random") >= ALPHA)
    one = runs.groupBy("r.token").agg(F.first("r").alias("r"))
    counts = one.groupBy(F.col("r.encoding").alias("encoding"), F.col("r.length_class").alias("length_class"), _bin(F.col("r.p_ordinary")).alias("bin")).count()
    whole = Window.partitionBy("encoding", "length_class")
    down = whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("rank", F.sum("count").over(down)).withColumn("m", F.sum("count").over(whole))
    largest_p = F.pow(F.lit(10.0), -F.col("bin") / F.lit(float(_BINS_PER_DECADE)))
    cut = ranked.where(largest_p <= F.col("rank") * F.lit(q) / F.col("m")).groupBy("encoding", "length_class").agg(F.min("bin").alias("bin"))
    return [(r.encoding, r.length_class, r.bin) for r in cut.collect()]


def secret_spans(docs: DataFrame, q: float = FDR) -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of ``struct<start, rank, kind, stop>``.

    ``spans`` is ``base`` and the runs that the battery finds random, where no
    base match covers them. Null texts have none; equal rows get equal results;
    columns of these names are replaced, others stay; an empty table gives an
    empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    limit_of = random_bins(docs, q)

    def random_run(r: Column) -> Column:
        limit = F.lit(_LAST_BIN + 1)
        for name, size_class, b in limit_of:
            limit = F.when((r["encoding"] == name) & (r["length_class"] == size_class), F.lit(b)).otherwise(limit)
        return (r["p_random"] >= ALPHA) & (_bin(r["p_ordinary"]) >= limit)

    def both(base: Column) -> Column:
        hits = F.filter(battery(open_runs(text, base)), random_run)
        more = F.transform(hits, lambda r: F.struct(r["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("random").alias("kind"), r["stop"].alias("stop")))
        spans = F.when(text.rlike(RUN), F.array_sort(F.concat(base, more))).otherwise(base)
        return F.struct(base.alias("base"), spans.alias("spans"))

    found = docs.drop("base", "spans").withColumn("_found", _bound(base_spans(text), both))
    return found.select(*[F.col("_found")[c].alias(c) if c in ("base", "spans") else F.col(c) for c in (*docs.drop("base", "spans").columns, "base", "spans")])


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]", q: float = FDR) -> DataFrame:
    """``docs`` with every secret span of the text replaced by ``mark``; other texts and all columns stay.

    Spans that overlap leave one mark. Null texts stay null; rows that repeat
    are alike; ``n_chars``, where there is one, follows the text.
    """
    text = F.col("text")
    piece = "struct<from:int,to:int>"
    later = lambda at, x: F.greatest(at, x["stop"])
    between = lambda at, x: F.struct(at.alias("from"), x["start"].alias("to"))
    kept = lambda spans: _scan(spans, piece, later, lambda at, x: x["start"] >= at, between)

    def spelt(group: Column) -> Column:
        # short pieces are taken out of the group's own stretch, as a place in a long text is found by counting from its start
        lo, hi = F.get(group, F.lit(0))["from"], F.get(group, F.size(group) - 1)["to"]
        own = lambda stretch: F.array_join(F.transform(group, lambda g: F.concat(F.substr(stretch, g["from"] - lo + 1, g["to"] - g["from"]), F.lit(mark))), "")
        return _bound(F.substr(text, lo + 1, hi - lo), own)

    masked = _bound(kept(F.col("_secrets")), lambda pieces: F.array_join(F.transform(_cut(pieces), spelt), ""))
    tail = F.substr(text, F.array_max(F.transform("_secrets", lambda s: s["stop"])) + 1)
    rest = [F.col(c) for c in docs.columns if c != "text"]
    named = docs.select(F.struct(F.lit(0).alias("_"), *rest).alias("_rest"), "text")
    found = secret_spans(named, q).select("_rest", "text", F.col("spans").alias("_secrets"))
    found = found.select("_rest", F.when(F.size("_secrets") > 0, F.concat(masked, tail)).otherwise(text).alias("text"))
    own = {"text": text, "n_chars": F.char_length("text").cast("long")}
    return found.select(*[own[c].alias(c) if c in own else F.col("_rest")[c].alias(c) for c in docs.columns])
