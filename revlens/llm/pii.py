"""Personal data: base patterns, and boosted trees over high-recall candidates.

*Base spans* follow fixed patterns for email, ip, card and phone, leftmost and not
overlapping per kind; ip parts must be at most 255, cards need 12 to 19 digits that pass
the Luhn check, phones 9 to 15 digits.  Base spans are always kept.

*Candidates.*  Three generators propose more, whatever it is, and may overlap: runs of
digits and number separators, numbers in telephone groups, and address-like texts, also
with spelled-out or bracketed ``at`` and ``dot``.  Each gets features of its format (digits, groups, separators, checks) and of its context
(neighbouring characters, cue words before it).

*Trees.*  Gradient-boosted trees learn from all candidates of this corpus: base spans and
telephone groups that end one are personal data, numbers
that fail a check are not, and what no rule decides is not learned from.  ``plain_numbers()``
adds rule-made negatives such as dates, versions and long numbers.  The
features that define the base patterns (the plus sign, the kind of ``at``) are withheld,
so what resembles base data is found without them.  Half of the candidates (by hash) calibrate:
each kind's threshold is the smallest score, in steps of 1 / STEPS, with precision PRECISION there.

Everything that touches the texts is built-in functions; the trees are one expression.
Candidates are counted by features; Spark sums each level's gradients by node, feature and value
(as whole numbers, so the order of adding does not matter), and the driver sees these sums only:
their number is bounded by the features' caps, whatever the corpus.  Patterns use character
runs, possessive where they repeat, so long runs need neither deep stacks nor rescans;
separators inside numbers and host names are first marked with a private character.

Offsets are code points, end exclusive.  Defined results: null text is empty; repeated rows
give repeated results; null doc_ids stay; without candidates only base spans are given;
extra columns are carried by ``redact`` and ignored by ``report``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from revlens.llm.store import stored

KINDS = ("email", "ip", "card", "phone")
STEPS, UNIT = 1 << 16, 1 << 24
ROUNDS, DEPTH, RATE, LEAST = 24, 3, 0.3, 4.0
PRECISION = 0.98
CONTEXT = 24

_MARK, _OTHER = "\ue000", "\ue001"
_LOCAL = r"A-Za-z0-9._%+\x{E000}-"
_EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@(?=[A-Za-z0-9-]++\x{{E000}})[A-Za-z0-9-][A-Za-z0-9\x{{E000}}-]*+"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9\x{E000}])(?=(?:[0-9]\x{E000}?){12})[0-9][0-9\x{E000}]*+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_NUMBER = r"(?<![0-9])[+(]{0,2}[0-9][0-9\x20()./+-]{5,40}[0-9](?![0-9])"
_NATIONAL = r"(?<![0-9])\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"
_ADDRESS = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?(?:@|[\[({]\x20?(?i:at)\x20?[\])}])\x20?[A-Za-z0-9-]{1,63}+"
            r"(?:\x20?(?:\.|[\[({]\x20?(?i:dot)\x20?[\])}])\x20?[A-Za-z0-9-]{1,63}+){1,6}"
            r"|\x20(?i:at)\x20[A-Za-z0-9-]{1,63}+(?:\x20(?i:dot)\x20[A-Za-z0-9-]{1,63}+){1,6})")
FEATURES = ("gen", "nd", "ng", "first", "last", "most", "dots", "dashes", "spaces", "parens", "slashes", "luhn", "octets", "before", "after", "cue", "tld", "upper")


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of the matches: their places follow from the lengths of the
    matches and of the texts between them."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)").alias("out"))

    def step(acc, both):
        s = acc["at"] + F.length(both["between"])
        e = s + F.length(both["found"])
        return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), both["found"].alias("m"))).alias("out"))
    pairs = F.filter(F.arrays_zip(found.alias("found"), between.alias("between")), lambda b: b["found"].isNotNull())
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _none():
    return F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(acc, i):
        v = digits.substr(n - i + 1, F.lit(1)).cast("int")
        doubled = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return acc + F.when(i % 2 == 0, doubled).otherwise(v)
    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0).otherwise(F.lit(False))


def _octets(text: Column) -> Column:
    def small(part):
        plain = F.regexp_replace(part, "^0+", "")
        return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)
    return F.forall(F.split(text, r"\."), small)


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e>> in order; k is the place of the kind in KINDS."""
    marked = F.translate(text, _MARK, _OTHER)
    hosts = F.regexp_replace(marked, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _MARK)
    numbers = F.regexp_replace(marked, r"(?<=[0-9])[\x20-](?=[0-9])", _MARK)
    n_digits = lambda x: F.length(_digits(x["m"]))
    kinds = (
        F.when(F.contains(text, F.lit("@")), _spans(hosts, _EMAIL)).otherwise(_none()),
        F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), F.filter(_spans(text, _IP), lambda x: _octets(x["m"]))).otherwise(_none()),
        F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), F.filter(_spans(numbers, _CARD), lambda x: _luhn(_digits(x["m"])))).otherwise(_none()),
        F.when(F.contains(text, F.lit("+")), F.filter(_spans(text, _PHONE), lambda x: n_digits(x).between(9, 15))).otherwise(_none()),
    )
    tagged = [F.transform(spans, _tag(k)) for k, spans in enumerate(kinds)]
    return F.array_sort(F.concat(*tagged))


def _tag(k: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))


def _features(text: Column, gen: int, x: Column) -> Column:
    m, digits = x["m"], _digits(x["m"])
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, F.length)
    count = lambda chars: F.least(F.length(m) - F.length(F.translate(m, chars, "")), F.lit(9))
    cap = lambda c, most: F.least(F.coalesce(c, F.lit(0)), F.lit(most)).cast("int")
    near = F.lower(F.substring(text, F.greatest(x["s"] - CONTEXT + 1, F.lit(1)), F.least(x["s"], F.lit(CONTEXT))))
    cue = (F.when(near.rlike(r"phone|tel\b|call|mobile|fax|dial"), 1).when(near.rlike(r"card|visa|credit|account"), 2)
           .when(near.rlike(r"mail|contact|write"), 3).when(near.rlike(r"\bip\b|host|server|address"), 4).otherwise(0))

    def side(c):
        return F.when(F.coalesce(c, F.lit("")).rlike(r"^\s?$"), 0).when(c.rlike("[A-Za-z]"), 1).when(c.rlike(r"[.,;:!?)\"']"), 2).otherwise(3)
    last = F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)
    values = {
        "gen": F.lit(gen), "nd": cap(F.length(digits), 24), "ng": cap(F.size(groups), 9), "first": cap(F.get(sizes, 0), 20),
        "last": cap(F.get(sizes, F.size(sizes) - 1), 20), "most": cap(F.array_max(sizes), 20), "dots": count("."), "dashes": count("-"),
        "spaces": count(" "), "parens": count("()"), "slashes": count("/"), "luhn": _luhn(digits).cast("int"),
        "octets": (m.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") & _octets(m)).cast("int"),
        "before": F.when(x["s"] == 0, 0).otherwise(side(F.substring(text, x["s"], F.lit(1)))), "after": side(F.substring(text, x["e"] + 1, F.lit(1))),
        "cue": cue, "tld": cap(F.length(last), 12), "upper": last.rlike("^[A-Z][a-z]").cast("int")}
    if gen == 1:
        values |= {k: F.lit(0) for k in ("nd", "ng", "first", "last", "most", "luhn", "octets")}
    else:
        values |= {k: F.lit(0) for k in ("tld", "upper")}
    return F.struct(*[values[f].cast("int").alias(f) for f in FEATURES])


def _kind(gen: int, m: Column, f: Column) -> Column:
    if gen == 1:
        return F.lit(0)
    return F.when(m.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), 1).when((f["nd"] >= 12) & (f["luhn"] == 1), 2).otherwise(3)


def candidates(text: Column, base: Column) -> Column:
    """array<struct<s, k, e, f, known, clear>>: known if it is a base span (up to the plus
    sign, or the end of a phone), clear if it overlaps none."""
    parts = []
    guards = ((0, _NUMBER, text.rlike(r"[0-9][0-9\x20()./+-]{5,40}[0-9]")),
              (0, _NATIONAL, text.rlike(r"[0-9][\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}|[0-9]\)[\x20.-][0-9]{3}")),
              (1, _ADDRESS, F.contains(text, F.lit("@")) | text.rlike(r"(?i)[\[({]\x20?at\x20?[\])}]|\x20at\x20[A-Za-z0-9-]{1,63}\x20dot\x20")))
    for gen, pattern, guard in guards:
        def one(x):
            f = _features(text, gen, x)
            kind = _kind(gen, x["m"], f)
            touch = F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
            known = F.exists(base, lambda b: (b["e"] == x["e"]) & (b["s"].between(x["s"], x["s"] + 1) | ((b["k"] == 3) & (b["s"] <= x["s"]))))
            return F.struct(x["s"].alias("s"), kind.cast("int").alias("k"), x["e"].alias("e"), f.alias("f"), known.alias("known"), (~touch).alias("clear"))
        found = _spans(text, pattern)
        if gen == 0:
            found = F.filter(found, lambda x: F.length(_digits(x["m"])) >= 7)
        fields = ",".join(f"{f}:int" for f in FEATURES)
        empty = F.expr(f"cast(array() as array<struct<s:int,k:int,e:int,f:struct<{fields}>,known:boolean,clear:boolean>>)")
        parts.append(F.when(guard, F.transform(found, one)).otherwise(empty))
    return F.concat(*parts)


def plain_numbers() -> list[tuple]:
    """Rule-made negatives, as (features): numbers that are no personal data."""
    def row(sizes, dots=0, dashes=0, spaces=0, slashes=0, parens=0, before=0, after=0):
        values = {"gen": 0, "nd": min(sum(sizes), 24), "ng": len(sizes), "first": min(sizes[0], 20), "last": min(sizes[-1], 20), "most": min(max(sizes), 20), "dots": dots,
                  "dashes": dashes, "spaces": spaces, "slashes": slashes, "parens": parens, "luhn": 0, "octets": 0, "before": before, "after": after, "cue": 0, "tld": 0, "upper": 0}
        return tuple(values[f] for f in FEATURES)
    out = []
    for before in (0, 1, 3):
        for after in (0, 1, 2, 3):
            side = {"before": before, "after": after}
            out += [row([n], **side) for n in range(7, 25)]                                             # plain numbers
            for a, b, c in ((4, 2, 2), (2, 2, 4), (1, 2, 4), (2, 1, 4), (4, 1, 2)):                     # dates
                out += [row([a, b, c], dashes=2, **side), row([a, b, c], dots=2, **side), row([a, b, c], slashes=2, **side)]
            out += [row([a, b], dots=1, **side) for a in range(1, 9) for b in range(1, 9) if a + b >= 7]  # decimals
            out += [row([a] + [b] * n, dots=n, **side) for a in (1, 2, 3) for b in (1, 2, 3) for n in (3, 4, 5)]  # versions, bad octets
            out += [row([a] + [3] * n, spaces=n, **side) for a in (1, 2, 3) for n in (2, 3)]              # thousands
            out += [row([4, 4], dashes=1, **side), row([4, 4], slashes=1, **side), row([4, 2], dashes=1, **side)]  # spans of years
            out += [row([4] * n, spaces=n - 1, **side) for n in (2, 3, 4, 5)] + [row([4] * n, dashes=n - 1, **side) for n in (3, 4, 5)]
    names = {f: i for i, f in enumerate(FEATURES)}
    for tld, upper, spaces, dots in [(t, 0, n, d) for t in (0, 1) for n in range(4) for d in (0, 1, 2)] + [(t, 1, n, d) for t in range(2, 9) for n in (1, 2, 3) for d in (0, 1)]:
        values = [0] * len(FEATURES)                                                                     # "at home. The"
        values[names["gen"]], values[names["tld"]], values[names["upper"]], values[names["spaces"]], values[names["dots"]] = 1, tld, upper, spaces, dots
        out.append(tuple(values))
    return out


class Trees:
    """Gradient boosting on the log loss; each tree is a nested list (feature, at, low, high)
    or a leaf value, where rows with value <= at go low.

    Trees grow level by level from sums of gradients: ``sums(trees, tree)`` gives the rows (node,
    feature, value, gradient, hessian) of the open nodes of ``tree``, under the scores of ``trees``."""

    def __init__(self, x=(), y=(), weight=()):
        self.start, self.trees, self.thresholds = 0.0, [], [2.0] * len(KINDS)
        if len(y):
            self.fit(_array_sums(x, y, weight), float(np.dot(weight, y)), float(np.sum(weight)))

    def fit(self, sums, good: float, every: float) -> "Trees":
        """Learns from rows of the weight ``every``, ``good`` of them positive."""
        share = min(max(good / every if every else 0.5, 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        for _ in range(ROUNDS if good else 0):
            tree = _Open()
            for depth in range(DEPTH):
                nodes = {}
                for node, *cell in sums(self, tree):
                    nodes.setdefault(node, []).append(cell)
                if not nodes:
                    break
                tree = _split(tree, {node: _best(cells, depth + 1 < DEPTH) for node, cells in nodes.items()})
            self.trees.append(tree)
        return self

    def predict(self, x):
        return 1 / (1 + np.exp(-(self.start + sum(_value(t, x) for t in self.trees))))

    def column(self, f: Column) -> Column:
        """The same probability as an expression over a struct of features."""
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + _case(tree, f)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def calibrate(self, x, y, weight, kind):
        """``limits`` from rows not learned from."""
        p = self.predict(x) if len(x) else np.zeros(0)
        return self.limits(zip(kind, np.floor(p * STEPS), weight * y, weight))

    def limits(self, rows):
        """Each kind's smallest threshold with the asked precision over (kind, step, positive weight, weight)."""
        table = np.array(sorted(rows, key=lambda r: -r[1]), float).reshape(-1, 4)
        for k in range(len(KINDS)):
            _, step, good, every = table[table[:, 0] == k].T
            good, every = np.cumsum(good), np.cumsum(every)
            ends = np.append(step[1:] < step[:-1], True) if len(step) else np.zeros(0, bool)
            fine = ends & (every >= LEAST) & (good >= PRECISION * every)
            self.thresholds[k] = float(max(0.5, step[np.flatnonzero(fine)[-1]] / STEPS - 1e-9)) if fine.any() else 2.0
        return self


class _Open:
    """A node that may still be split."""


def _best(cells, more: bool):
    """The node of the best split of (feature, value, gradient, hessian) rows, its low and high
    side open if ``more`` levels follow; a leaf value if no split gains."""
    cells = np.array(sorted(cells), float)
    one = cells[cells[:, 0] == 0]
    g, h = one[:, 2].sum(), one[:, 3].sum()
    leaf = lambda g, h: _Open() if more else float(RATE * g / (h + 1.0))
    best, node = 1e-6, float(RATE * g / (h + 1.0))
    for f in range(len(FEATURES)):
        _, value, gs, hs = cells[cells[:, 0] == f].T
        if len(value) < 2:
            continue
        gs, hs = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
        gain = gs ** 2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g ** 2 / (h + 1)
        gain[(hs < 1e-3) | (h - hs < 1e-3)] = 0
        i = int(np.argmax(gain))
        if gain[i] > best:
            best, node = gain[i], [f, int(value[i]), leaf(gs[i], hs[i]), leaf(g - gs[i], h - hs[i])]
    return node


def _split(tree, nodes: dict, at: int = 1):
    """``tree`` with its open nodes replaced; node n has the sides 2 n and 2 n + 1."""
    if isinstance(tree, list):
        return [*tree[:2], _split(tree[2], nodes, 2 * at), _split(tree[3], nodes, 2 * at + 1)]
    return nodes[at] if isinstance(tree, _Open) else tree


def _value(tree, x, at: int = 1):
    """Leaf values of the rows, or their open nodes (0: none is open)."""
    if isinstance(tree, list):
        return np.where(x[:, tree[0]] <= tree[1], _value(tree[2], x, 2 * at), _value(tree[3], x, 2 * at + 1))
    return np.full(len(x), at if isinstance(tree, _Open) else tree)


def _case(tree, f: Column, leaf=lambda tree, at: F.lit(tree), at: int = 1) -> Column:
    if not isinstance(tree, list):
        return leaf(tree, at)
    return F.when(f[FEATURES[tree[0]]] <= tree[1], _case(tree[2], f, leaf, 2 * at)).otherwise(_case(tree[3], f, leaf, 2 * at + 1))


def _node(tree, at: int) -> Column:
    return F.lit(at if isinstance(tree, _Open) else 0)


def _opened(tree):
    """``tree`` with 0 for its closed leaves."""
    if isinstance(tree, list):
        return [*tree[:2], _opened(tree[2]), _opened(tree[3])]
    return tree if isinstance(tree, _Open) else 0


def _array_sums(x, y, weight):
    """Sums over the rows of arrays."""
    def sums(trees, tree):
        p, node = trees.predict(x), _value(_opened(tree), x)
        for n in np.unique(node[node > 0]):
            rows = node == n
            for f in range(x.shape[1]):
                value, place = np.unique(x[rows, f], return_inverse=True)
                yield from ((n, f, *cell) for cell in zip(value, np.bincount(place, (weight * (y - p))[rows]), np.bincount(place, (weight * p * (1 - p))[rows])))
    return sums


class _CellSums:
    """The same over a table (f, known, n) of counted features, added up by Spark.  Its scores are
    kept from round to round, so that a round's expressions hold one tree."""

    def __init__(self, cells: DataFrame):
        self.done, self.rows = 0, cells.withColumn("score", F.lit(0.0)).persist()

    def __call__(self, trees, tree):
        f, n, before = F.col("f"), F.col("n"), self.rows
        for new in trees.trees[self.done:]:
            self.rows = self.rows.withColumn("score", F.col("score") + _case(new, f))
        if self.done < len(trees.trees):
            self.done, self.rows = len(trees.trees), self.rows.persist()
        values = F.array(*[F.struct(F.lit(i).alias("feature"), f[name].alias("value")) for i, name in enumerate(FEATURES)])
        whole = lambda c: F.round(c * UNIT).cast("long") * n
        scored = self.rows.withColumn("node", _case(tree, f, _node)).where("node > 0").withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("score") + F.lit(trees.start)))))
        each = scored.select("node", whole(F.col("known").cast("double") - F.col("p")).alias("g"), whole(F.col("p") * (1 - F.col("p"))).alias("h"), F.explode(values).alias("v"))
        rows = each.groupBy("node", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        if before is not self.rows:
            before.unpersist()
        return [(r["node"], r["v"]["feature"], r["v"]["value"], r["g"] / UNIT, r["h"] / UNIT) for r in rows]


def train(found: DataFrame) -> Trees:
    """Trees from all exploded candidates that a rule decides (h: hash of row, c)."""
    f = "c.f."
    fails = (F.col(f + "nd") < 9) | (F.col(f + "nd") > 19) | ((F.col(f + "dots") == 3) & (F.col(f + "ng") == 4) & (F.col(f + "octets") == 0)) \
        | ((F.col(f + "nd") >= 12) & (F.col(f + "luhn") == 0) & F.col(f + "ng").isin(1, 4))
    decided = found.where(F.col("c.known") | ((F.col(f + "gen") == 0) & fails)).select("c.f", "c.k", "c.known", F.pmod("h", F.lit(2)).cast("int").alias("half"))
    fields = ",".join(f"{name}:int" for name in FEATURES)
    plain = found.sparkSession.createDataFrame([(x, 0 if x[0] else 3, False, half) for x in plain_numbers() for half in (0, 1)], f"f struct<{fields}>, k int, known boolean, half int")
    cells = stored(decided.unionByName(plain).groupBy("f", "k", "known", "half").agg(F.count(F.lit(1)).alias("n")), "pii-cells")
    learn, rest = cells.where("half = 0"), cells.where("half = 1")
    count = learn.agg(F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("every")).first()
    sums = _CellSums(learn)
    trees = Trees().fit(sums, count["good"], count["every"])
    sums.rows.unpersist()
    scored = rest.withColumn("step", F.floor(trees.column(F.col("f")) * STEPS))
    good = F.sum(F.when(F.col("known"), F.col("n")).otherwise(0))
    return trees.limits(scored.groupBy("k", "step").agg(good.alias("good"), F.sum("n").alias("every")).collect())


def _found(docs: DataFrame, *keep: str) -> DataFrame:
    """(row, base, cand): stored, one row per row of ``docs``; texts are read once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(keep or ("*",))).alias("row"), text.alias("plain")).withColumn("base", base_spans(F.col("plain")))
    return stored(rows.select("row", "base", candidates(F.col("plain"), F.col("base")).alias("cand")), "pii")


def detect(docs: DataFrame, *keep: str) -> DataFrame:
    """(row, base, spans): array<struct<s, k, e>> of the base spans and of all spans, for every
    row of ``docs`` (a struct of the columns ``keep``, all without any)."""
    found = _found(docs, *keep)
    each = found.where(F.size("cand") > 0).select("row", F.explode("cand").alias("c"))
    trees = train(each.select(F.xxhash64(F.to_json("row"), "c.s", "c.e").alias("h"), "c"))
    limits = F.array(*[F.lit(t) for t in trees.thresholds])
    scored = F.transform(F.filter("cand", lambda c: c["clear"]), lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), trees.column(c["f"]).alias("p")))
    chosen = F.filter("scored", lambda c: c["p"] >= F.get(limits, c["k"]))
    # of overlapping candidates the likelier one stays, then the earlier, then the longer; two
    # generators may propose one span
    rank = lambda c: F.struct(c["s"], -c["e"], c["k"])
    best = F.filter("chosen", lambda c: ~F.exists("chosen", lambda o: (o["s"] < c["e"]) & (c["s"] < o["e"])
                                                  & ((o["p"] > c["p"]) | ((o["p"] == c["p"]) & (rank(o) < rank(c))))))
    plain = F.array_distinct(F.transform("best", lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))
    out = found.withColumn("scored", scored).withColumn("chosen", chosen).withColumn("best", best)
    return out.select("row", "base", F.array_sort(F.concat("base", plain)).alias("spans"))


def _written(spans) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _is(k: int):
    return lambda x: x["k"] == k


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans); counts are base spans."""
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return detect(docs, "doc_id").select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans are
    replaced together, under the kind of the first."""
    text = F.col("row.text").cast("string")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        before = F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.get(names, x["k"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), before.alias("out"))
    new = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    found = detect(docs)
    return found.select(*[F.when(F.size("spans") > 0, new).otherwise(F.col("row.text")).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
