"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Base patterns of four kinds are always kept. High-recall generators propose further, overlapping spans: addresses written
with "at" and "dot", telephone numbers without a plus sign, card and IP numbers in other groupings. Boosted trees score
each proposal from its format and its context, one ensemble a kind, compiled to SQL CASE expressions; a proposal is taken
where its calibrated probability reaches its kind's threshold and it overlaps no base span and no better proposal.

Spans are found by splitting a text at a pattern and summing the lengths of the pieces, so positions are code points and
each text is one row: nothing is shuffled. Patterns are possessive and start only at the start of a run (or where the
last match ended), so they take linear time on any text.

The trees are trained on the driver on TRAINING seeded examples that this module writes, since no table marks spans.
The thresholds come from a held-out third: the lowest probability whose precision is PRECISION, LEAST at least.
Edge cases: a null or empty text has no spans; repeated rows repeat; other columns are kept by `with_spans`; an empty
table gives an empty result.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name

KINDS = ["email", "ip", "card", "phone"]
TRAINING, ROUNDS, DEPTH, RATE = 6_000, 20, 3, 0.3
PRECISION, LEAST = 0.99, 0.9

# fixed values: the base patterns, written so that they can't backtrack
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
# an address has 64 characters before its sign and 63 in a label at most, a number of any kind fewer than 26 digits
PROPOSALS = {
    "spelled": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?[\[({] ?at ?[\])}] ?| at |@ | @ | @)[A-Za-z0-9-]{1,63}+(?:(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)[A-Za-z0-9-]{2,63}+){1,4}+",
    "digits": r"(?<![A-Za-z0-9.,/$-])(?:00 ?|\()?[0-9](?:[ ().\x2D/]{0,2}[0-9]){6,24}+(?![A-Za-z0-9])",
    "quads": r"(?<![0-9])[0-9]{4}([ ._/-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "local": r"(?<![0-9])\(?[0-9]{3}\)?[ ./-]{1,2}[0-9]{3}[ ./-][0-9]{4}(?![0-9])",
    "dotted": r"(?<![0-9.])[0-9]{1,3}(?: ?[\[(]\.[\])] ?| \. |\.)[0-9]{1,3}(?: ?[\[(]\.[\])] ?| \. |\.)[0-9]{1,3}(?: ?[\[(]\.[\])] ?| \. |\.)[0-9]{1,3}(?![0-9.])",
}
SPAN = "struct<k:int,s:int,e:int,m:string,b:string,a:string>"
NONE = f"cast(array() as array<{SPAN}>)"


def _scanned(df: DataFrame, values: str, to: str, zero: str, op: str) -> DataFrame:
    """df with an array `to`: op over all values before each, from zero on (op is SQL of t and x, which must be associative).

    An array that grows by one copies itself each time, so the values are cut into about as many blocks as a block has
    values: n values take in the order of n ** 1.5 steps and not n * n.
    """
    blocks, each, n = f"{to}__b", f"{to}__o", f"size({values})"
    run = "aggregate({of}, named_struct('t', {start}, 'o', cast(array() as array<int>)), (a, y) -> named_struct('t', {op}, 'o', array_append(a.o, a.t)), a -> a.o)"
    step = op.replace("t", "a.t", 1).replace("x", "y", 1) if op == "t + x" else op.replace("(t, x)", "(a.t, y)")
    df = df.withColumn(blocks, F.expr(f"CASE WHEN {n} > 0 THEN transform(sequence(0, {n} - 1, cast(ceil(sqrt({n})) as int)), p -> slice({values}, p + 1, cast(ceil(sqrt({n})) as int))) END"))
    df = df.withColumn(each, F.expr(run.format(of=f"transform({blocks}, b -> aggregate(b, {zero}, (t, x) -> {op}))", start=zero, op=step)))
    inner = run.format(of="b", start="s", op=step)
    return df.withColumn(to, F.expr(f"CASE WHEN {n} > 0 THEN flatten(zip_with({blocks}, {each}, (b, s) -> {inner})) END")).drop(blocks, each)


def _found(df: DataFrame, text: str, pattern: str, kind: int, to: str, when: Column) -> DataFrame:
    """df with the matches of pattern in column `to`: kind, start, end, match and what stands before and after."""
    hits, gaps, lens, at = (f"{to}__{c}" for c in "mglp")
    df = df.withColumn(hits, F.when(when, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.split(F.col(text), pattern, -1)))
    df = df.withColumn(lens, F.expr(f"CASE WHEN size(`{hits}`) > 0 THEN zip_with(slice(`{gaps}`, 1, size(`{hits}`)), `{hits}`, (g, m) -> length(g) + length(m)) END"))
    df = _scanned(df, lens, at, "0", "t + x")
    m, g, p = f"`{hits}`[i - 1]", f"`{gaps}`[i - 1]", f"`{at}`[i - 1]"
    span = f"named_struct('k', {kind}, 's', {p} + length({g}), 'e', {p} + length({g}) + length({m}), 'm', {m}, 'b', right({g}, 24), 'a', left(`{gaps}`[i], 8))"
    return df.withColumn(to, F.expr(f"CASE WHEN size(`{hits}`) > 0 THEN transform(sequence(1, size(`{hits}`)), i -> {span}) ELSE {NONE} END")).drop(hits, gaps, lens, at)


def _luhn(digits: str) -> str:
    twice = f"aggregate(sequence(1, greatest(length({digits}), 1)), 0, (t, j) -> t + CASE WHEN (length({digits}) - j) % 2 = 0 THEN coalesce(try_cast(substr({digits}, j, 1) as int), 0) ELSE 2 * coalesce(try_cast(substr({digits}, j, 1) as int), 0) - CASE WHEN coalesce(try_cast(substr({digits}, j, 1) as int), 0) > 4 THEN 9 ELSE 0 END END)"
    return f"({twice} % 10 = 0)"


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_PARTS = "filter(split(x.m, '[^0-9]+'), p -> p <> '')"
_OCTETS = f"forall({_PARTS}, p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)"
VALID = {
    "email": "true",
    "ip": _OCTETS,
    "card": f"(length({_DIGITS}) BETWEEN 13 AND 19 AND {_luhn(_DIGITS)})",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}
#: Format and context of a proposal x, as SQL of number or truth value.
FEATURES = {
    "length": "length(x.m)",
    "digits": f"length({_DIGITS})",
    "groups": f"size({_PARTS})",
    "longest": f"coalesce(array_max(transform({_PARTS}, p -> length(p))), 0)",
    "letters": "length(regexp_replace(x.m, '[^A-Za-z]', ''))",
    "first": f"coalesce(try_cast(left({_DIGITS}, 1) as int), -1)",
    "zeros": f"startswith({_DIGITS}, '00')",
    "paren": "contains(x.m, '(')",
    "luhn": _luhn(_DIGITS),
    "octets": f"(size({_PARTS}) = 4 AND {_OCTETS})",
    "at": "contains(x.m, '@')",
    "bracket_at": "rlike(lower(x.m), '[(\\\\[{] ?at ?[)\\\\]}]')",
    "word_dot": "rlike(lower(x.m), ' dot |[(\\\\[{] ?dot ?[)\\\\]}]')",
    "domain_end": "length(regexp_extract(x.m, '([A-Za-z]*)$', 1))",
    "local_mark": "rlike(x.m, '^[A-Za-z0-9%+-]*[0-9._]')",
    "three_four": "rlike(x.m, '^[(]?[0-9]{3}[)]?[ ./-]{1,2}[0-9]{3}[ ./-][0-9]{4}$')",
    "quads": "rlike(x.m, '^[0-9]{4}([ ._/-]?[0-9]{4}){3}$')",
    "dotted": "rlike(x.m, '^[0-9]{1,3}( ?[(\\\\[]?[.][)\\\\]]? ?[0-9]{1,3}){3}$')",
    "date": "rlike(x.m, '^(19|20)[0-9]{2}[-/. ]|[-/. ](19|20)[0-9]{2}$')",
    "about_phone": "rlike(lower(x.b), 'tel|phone|call|fax|mobile|cell')",
    "about_card": "rlike(lower(x.b), 'card|visa|credit|debit')",
    "about_host": "rlike(lower(x.b), 'ip|host|server|addr')",
    "about_mail": "rlike(lower(x.b), 'mail|contact|write|reach')",
    "about_other": "rlike(lower(x.b), 'isbn|order|invoice|version|serial|date|ref|no[.]|page|year|item|id')",
}


def examples(n: int = TRAINING, seed: int = 11) -> list[tuple[str, str, str]]:
    """(text, kind or '', span): seeded texts with one span each, of a kind or of none."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abdeilmnorstu") for _ in range(r.randint(2, 8)))

    def card():
        body = r.choice("3456") + digits(14)
        total = sum(int(c) if k % 2 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(body))
        return body + str(-total % 10)

    def one(kind):
        if kind == "email":
            at, dot = r.choice([(" (at) ", "."), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"), (" @ ", "."), (" (at) ", " (dot) ")])
            return word() + r.choice(["", ".", "_"]) + r.choice([word(), digits(2)]) + at + word() + dot + r.choice(["com", "org", "net", "de", "fr", "example.com"]), ["mail ", "contact ", "write to ", "", ""]
        if kind == "phone":
            shape = r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"00{digits(2)} {digits(3)} {digits(3)} {digits(3)}"])
            return shape, ["tel. ", "phone: ", "call ", "fax ", "mobile ", ""]
        if kind == "card":
            c, sep = card(), r.choice([".", "/", "_", " - "[1]])
            return sep.join(c[k : k + 4] for k in range(0, 16, 4)), ["card ", "visa ", "credit card ", ""]
        if kind == "ip":
            return r.choice(["[.]", "(.)", " . "]).join(str(r.randint(0, 255)) for _ in range(4)), ["ip ", "host ", "server ", "address ", ""]
        what = r.randint(0, 8)
        before = ["order ", "invoice ", "item ", "version ", "date ", "", "page "]
        if what == 0:
            return f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02} {digits(2)}", before
        if what == 1:
            return f"{digits(3)}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", ["isbn "]
        if what == 2:
            return digits(r.randint(7, 18)), before
        if what == 3:
            return f"{word()} at {word()}.{word()}", ["", "look "]
        if what == 4:
            return " ".join(digits(r.randint(1, 5)) for _ in range(r.randint(3, 7))), before
        if what == 5:
            return ".".join(digits(4) for _ in range(4)), before
        if what == 6:
            return ".".join(digits(r.randint(1, 2)) for _ in range(r.randint(4, 6))), ["version ", ""]
        if what == 7:
            return f"{digits(3)} {digits(3)} {digits(4)}", before
        return " . ".join(str(r.randint(0, 999)) for _ in range(4)), before

    out = []
    for k in range(n):
        kind = (KINDS + [""] * 4)[k % 8]
        span, before = one(kind)
        lead = " ".join(word() for _ in range(r.randint(0, 4)))
        out.append((f"{lead}{', ' if lead else ''}{r.choice(before)}{span}, {word()} {word()}.", kind, span))
    return out


class Trees:
    """Gradient boosting of the logistic loss by small regression trees."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 17)[1:])) for c in x.T]
        z = np.full(len(y), self.start)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(x, cuts, y - p, p * (1 - p), np.ones(len(y), bool), DEPTH)
            self.trees.append(tree)
            z += self._apply(tree, x)

    def _grow(self, x, cuts, g, h, at, depth):
        leaf = float(RATE * g[at].sum() / (h[at].sum() + 1.0))
        if depth == 0 or at.sum() < 20:
            return leaf
        whole = g[at].sum() ** 2 / (h[at].sum() + 1)
        best = (1e-3, None)
        for f, values in enumerate(cuts):
            for cut in values:
                low = at & (x[:, f] < cut)
                high = at & ~low
                if low.sum() >= 10 and high.sum() >= 10:
                    gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1) - whole
                    best = max(best, (gain, (f, float(cut), low, high)), key=lambda b: b[0])
        if best[1] is None:
            return leaf
        f, cut, low, high = best[1]
        return (f, cut, self._grow(x, cuts, g, h, low, depth - 1), self._grow(x, cuts, g, h, high, depth - 1))

    def _apply(self, tree, x):
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] < cut, self._apply(low, x), self._apply(high, x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + sum(self._apply(t, x) for t in self.trees))))

    def sql(self, row: str) -> str:
        """The logit, of an array of feature values."""

        def one(t):
            return f"{t:.6f}D" if isinstance(t, float) else f"CASE WHEN {row}[{t[0]}] < {t[1]:.6f}D THEN {one(t[2])} ELSE {one(t[3])} END"

        return " + ".join([f"{self.start:.6f}D", *map(one, self.trees)])


def _values(of: str) -> str:
    return "array(" + ", ".join(f"cast({f} as double)" for f in FEATURES.values()) + ")" if of == "x" else of


def _proposed(df: DataFrame, text: str) -> DataFrame:
    """Column p__all: the proposals of all generators."""
    digits = F.col(text).rlike("[0-9][^A-Za-z]{0,3}[0-9]")
    spelled = F.col(text).rlike(r"(?i)[\[({ ]at[\])} ]") | F.col(text).contains("@")
    for k, (name, pattern) in enumerate(PROPOSALS.items()):
        df = _found(df, text, pattern, k, f"p__{name}", spelled if name == "spelled" else digits)
    return df.withColumn("p__all", F.concat(*(f"p__{n}" for n in PROPOSALS))).drop(*(f"p__{n}" for n in PROPOSALS))


@lru_cache(maxsize=1)
def _trained(rows: tuple) -> dict[str, tuple[Trees, float]]:
    data = list(rows)
    x, kinds = np.array([d[0] for d in data]), np.array([d[1] for d in data])
    held = np.arange(len(x)) % 3 == 0
    out = {}
    for kind in KINDS:
        model = Trees(x[~held], (kinds[~held] == kind).astype(float))
        p, y = model.probability(x[held]), kinds[held] == kind
        order = np.argsort(-p, kind="stable")
        precision = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(precision >= PRECISION)
        out[kind] = (model, max(LEAST, float(p[order[good[-1]]]) if len(good) else 1.0))
    return out


def train(spark: SparkSession) -> dict[str, tuple[Trees, float]]:
    """Trees and threshold of each kind, from the same generators and features that texts go through."""
    made = spark.createDataFrame(examples(), "text string, kind string, span string")
    seen = _proposed(made, "text").select("kind", "span", F.expr(f"inline(transform(p__all, x -> named_struct('m', x.m, 'v', {_values('x')})))"))
    rows = sorted((tuple(r["v"]), r["kind"] if r["m"] == r["span"] else "") for r in seen.collect())
    chance = random.Random(5)
    chance.shuffle(rows)
    return _trained(tuple(rows))


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with columns base and spans (with an underscore more where docs has these): arrays of (k, s, e), by kind and start."""
    models = train(docs.sparkSession)
    text = "p__text"
    df = docs.select(F.struct("*").alias("p__row"), F.coalesce("text", F.lit("")).alias(text))
    for k, (kind, pattern) in enumerate(BASE.items()):
        hint = F.col(text).contains(HINT[kind]) if HINT[kind] else F.lit(True)
        df = _found(df, text, pattern, k, f"b__{kind}", hint & F.col(text).rlike("[0-9]") if kind != "email" else hint)
        df = df.withColumn(f"b__{kind}", F.expr(f"filter(b__{kind}, x -> {VALID[kind]})"))
    df = df.withColumn("base", F.expr("transform(concat(" + ", ".join(f"b__{k}" for k in KINDS) + "), x -> named_struct('k', x.k, 's', x.s, 'e', x.e))")).drop(*(f"b__{k}" for k in KINDS))
    df = _proposed(df, text)
    # a proposal meets a base span where one that starts no later ends beyond its start, or the next one starts before its end
    # (arrays meet in arrays_zip and not by index in a lambda, where a plan may compute them anew for each element)
    df = df.withColumn("p__both", F.expr("CASE WHEN size(p__all) > 0 THEN array_sort(concat(transform(base, x -> named_struct('s', x.s, 'p', 0, 'e', x.e, 'i', -1, 'x', p__none)), transform(p__all, (x, i) -> named_struct('s', x.s, 'p', 1, 'e', x.e, 'i', i, 'x', x)))) END".replace("p__none", f"cast(null as {SPAN})")))
    df = df.withColumn("p__ends", F.expr("transform(p__both, x -> CASE WHEN x.p = 0 THEN x.e ELSE 0 END)")).withColumn("p__starts", F.expr("reverse(transform(p__both, x -> CASE WHEN x.p = 0 THEN x.s ELSE 2147483647 END))"))
    df = _scanned(_scanned(df, "p__ends", "p__before", "0", "greatest(t, x)"), "p__starts", "p__next", "2147483647", "least(t, x)").withColumn("p__after", F.reverse("p__next"))
    apart = "transform(filter(arrays_zip(p__both, p__before, p__after), z -> z.p__both.p = 1 AND z.p__before <= z.p__both.s AND z.p__after >= z.p__both.e), z -> z.p__both.x)"
    logits = [f"named_struct('l', ({models[kind][0].sql('v.f')}) - {np.log(models[kind][1] / max(1e-9, 1 - models[kind][1])):.6f}D, 'k', {k})" for k, kind in enumerate(KINDS)]
    df = df.withColumn("p__values", F.expr(f"transform({apart}, x -> named_struct('s', x.s, 'e', x.e, 'f', {_values('x')}))"))
    df = df.withColumn("p__best", F.expr(f"filter(transform(p__values, v -> named_struct('best', array_max(array({', '.join(logits)})), 's', v.s, 'e', v.e)), v -> v.best.l >= 0)"))
    # they come in order of their starts: those that overlap are cut apart from the rest, and the best of each such group is taken first
    df = _scanned(df.withColumn("p__e", F.expr("transform(p__best, v -> v.e)")), "p__e", "p__reach", "0", "greatest(t, x)")
    firsts = "filter(transform(arrays_zip(p__best, p__reach), (z, i) -> CASE WHEN z.p__reach <= z.p__best.s THEN i ELSE -1 END), i -> i >= 0)"
    df = df.withColumn("p__first", F.expr(f"CASE WHEN size(p__best) > 0 THEN {firsts} END")).withColumn("p__last", F.expr("concat(slice(p__first, 2, size(p__first)), array(size(p__best)))"))
    groups = "transform(arrays_zip(p__first, p__last), z -> slice(p__best, z.p__first + 1, z.p__last - least(z.p__first, size(p__best))))"
    order = "(u, v) -> CASE WHEN u.best.l > v.best.l THEN -1 WHEN u.best.l < v.best.l THEN 1 WHEN u.s < v.s THEN -1 WHEN u.s > v.s THEN 1 WHEN u.e > v.e THEN -1 WHEN u.e < v.e THEN 1 ELSE 0 END"
    taken = f"aggregate(array_sort(g, {order}), cast(array() as array<struct<k:int,s:int,e:int>>), (t, v) -> CASE WHEN exists(t, y -> v.s < y.e AND y.s < v.e) THEN t ELSE array_append(t, named_struct('k', v.best.k, 's', v.s, 'e', v.e)) END)"
    df = df.withColumn("p__taken", F.expr(f"coalesce(flatten(transform({groups}, g -> {taken})), cast(array() as array<struct<k:int,s:int,e:int>>))"))
    return df.select("p__row.*", F.col("base").alias(free_name(docs, "base")), F.expr("array_sort(concat(base, p__taken))").alias(free_name(docs, "spans")))


def listed(column: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({column}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets."""
    df, base, spans = with_spans(docs), free_name(docs, "base"), free_name(docs, "spans")
    names = "array(" + ", ".join(f"'[{k}]'" for k in KINDS) + ")"
    # spans of two kinds may overlap: each piece starts where all spans before have ended
    df = df.withColumn("r__x", F.expr(f"array_sort(transform({spans}, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k)))"))
    df = _scanned(df.withColumn("r__e", F.expr("transform(r__x, x -> x.e)")), "r__e", "r__p", "0", "greatest(t, x)")
    pieces = f"transform(r__x, (x, i) -> concat(substr(text, r__p[i] + 1, greatest(x.s - r__p[i], 0)), {names}[x.k]))"
    whole = f"concat(array_join({pieces}, ''), substr(text, greatest(element_at(r__p, -1), element_at(r__x, -1).e) + 1))"
    return df.withColumn("text", F.expr(f"CASE WHEN size(r__x) > 0 THEN {whole} ELSE text END")).drop(base, spans, "r__x", "r__e", "r__p")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    df = with_spans(docs.select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
