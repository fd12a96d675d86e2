"""Personal data: candidate spans, boosted trees, calibrated thresholds; DataFrame expressions throughout.

Per kind (email, ip, card, phone) generators of high recall propose spans that may overlap: whatever has the kind's shape,
also without its mark (no plus), veiled ("(at)", "[.]") or within a run that the kind's own pattern takes whole and then
drops (two cards in a row). A candidate counts if it passes the kind's check once it is unveiled. Base spans, found by the
kind's own pattern and check, always stay.

Boosted trees of depth two tell candidates that meet a base span of their kind from all others, by features of format
(digits, brackets, separators, labels) and of context (characters beside it, words of the kind before it). What only base spans
can have, the plus, the plain at sign or dot and a card's separators, is not among the features; so the trees cannot repeat the base pattern.
Base spans are a labelled part of what is sought, and the others are unlabelled, not negative: a candidate's score is
compared with the mean score of base spans (their label frequency), not with one half. So veiled forms are found
also where they are more common than plain ones. That mean comes from texts the trees have not been fitted to. A table
may have few base spans or none, so a second set of trees is fitted to ``PRIOR`` texts a kind, made by rule. A candidate's
margins over both thresholds are averaged, the table's own with weight n / (n + ``PRIOR_WEIGHT``) for n base spans
in the smaller fold: there is no count at which a kind begins to add. Selected candidates that meet no base span of any kind are
added; of those that overlap, that of the earlier generator stays. The trees' leaves are one SQL expression.

Training sees every candidate of the corpus, as counts of distinct feature vectors. These are few, as all features are
small integers; the ``VECTORS`` most frequent ones are collected, and the trees are fitted to them in plain Python.

Patterns are written so that the regular-expression engine neither backtracks over runs nor recurs once per repeat; on
texts of any length they are linear. Texts without a digit or an at sign cost one look. Positions are code points.

Defined results: null text is empty and has no spans; a null id is kept; repeated rows give repeated results; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store, table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns of the contract, in a form that scans in linear time and finds the same spans. An email's run of
#: local characters is entered at its start or where the last match ended; its domain ends before an empty label.
#: A card is a whole run of digits with single separators; runs of over 19 digits fail the check, so they are not matched.
BASE = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])[A-Za-z0-9.-]*?(?=\.\.|\.?+(?![A-Za-z0-9.-]))",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_AT = r"(?:\x20?(?:\(at\)|\[at\]|\{at\})\x20?)"
_DOT = r"(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\(\.\)|\[\.\])\x20?)"
#: The generators: kind, and what it takes for a candidate.
WIDE = (
    (0, r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+@[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){1,4}"),
    (0, r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+" + _AT + r"[a-z0-9-]{1,63}(?:(?:" + _DOT + r"|\.)[a-z0-9-]{2,63}){1,4}"),
    (0, r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?:@[a-z0-9-]{1,63}(?:" + _DOT + r"[a-z0-9-]{2,63}){1,4}|\x20at\x20[a-z0-9-]{1,63}(?:\x20dot\x20[a-z0-9-]{2,63}){1,4})"),
    (1, r"(?<![0-9])[0-9]{1,3}(?:\.|\[\.\]|\(\.\))[0-9]{1,3}(?:\.|\[\.\]|\(\.\))[0-9]{1,3}(?:\.|\[\.\]|\(\.\))[0-9]{1,3}(?![0-9])"),
    (2, r"(?<![0-9])[0-9]{14,19}(?![0-9])"),
    (2, r"(?<![0-9])[0-9]{4}[\x20./_-](?:[0-9]{4}[\x20./_-][0-9]{4}[\x20./_-][0-9]{2,7}|[0-9]{6}[\x20./_-][0-9]{4,5})(?![0-9])"),
    (3, r"(?<![0-9+])(?:\+|00)?(?:[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])"),
)
CUES = (
    r"(?i)mail|contact|write|schreib|correo|courriel",
    r"(?i)\bip\b|address|server|host|adresse|direcci",
    r"(?i)card|visa|karte|tarjeta|carte|account|konto",
    r"(?i)tel|phone|call|fax|mobil|ruf|llam|appel",
)
#: Share of the base spans' mean score that a candidate needs.
SHARE = 0.5
#: Texts of each kind for the trees that no table decides, and how many of a table's base spans outweigh these.
PRIOR = 120
PRIOR_WEIGHT = 20
VECTORS = 20_000
ROUNDS = 24
RATE = 0.4
#: Matches whose places are summed in one go; sums over groups of this many keep the work linear.
GROUP = 256
FOUND = "array<struct<s:int,e:int,m:string,l:string,r:string>>"
#: Characters of context before a candidate; it reaches back to the candidate before at most.
CONTEXT = 24
FEATURES = ("digits", "brackets", "seps", "labels", "tail", "before", "after", "cue", "lead")
CANDIDATE = "struct<by:int,s:int,e:int,base:boolean," + ",".join(f"{f}:int" for f in FEATURES) + ">"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body's lambdas use it for each element."""
    return F.transform(F.array(value), body)[0]


def located(text: Column, pattern: str) -> Column:
    """The pattern's matches, from left to right: array of (s, e, m), and what is beside them (l, r)."""

    def places(found: Column, between: Column) -> Column:
        def part(m: Column, i: Column) -> Column:
            gap, following = F.get(between, i), F.get(between, i + 1)
            return F.struct(F.char_length(gap).alias("g"), m.alias("m"), F.right(gap, F.lit(CONTEXT)).alias("l"), F.left(following, F.lit(1)).alias("r"))

        parts = F.transform(found, part)

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["g"]
            end = start + F.char_length(x["m"])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), x["l"].alias("l"), x["r"].alias("r")))).alias("out"))

        def whole(all_: Column) -> Column:
            groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / GROUP).cast("int")), lambda i: F.slice(all_, i * GROUP + 1, GROUP))

            def group(acc: Column, part: Column) -> Column:
                start = F.struct(acc["at"].alias("at"), F.array().cast(FOUND).alias("out"))
                inner = let(F.aggregate(part, start, step), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))
                return inner

            start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{FOUND}>").alias("out"))
            return F.flatten(F.aggregate(groups, start, group)["out"])

        return let(parts, whole)

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, F.array().cast(FOUND)).otherwise(let(F.split(text, pattern, -1), lambda between: places(found, between))),
    )


def grouped(spans: Column) -> Column:
    """Spans in order by groups of ``GROUP`` with their bounds (lo, hi): to look for an overlap without a look at each."""

    def bounded(part: Column) -> Column:
        return F.struct(part[0]["s"].alias("lo"), F.array_max(F.transform(part, lambda x: x["e"])).alias("hi"), F.transform(part, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias("spans"))

    def groups(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / GROUP).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: let(F.slice(all_, i * GROUP + 1, GROUP), bounded))
        return F.when(F.size(all_) > 0, cut).otherwise(F.array().cast("array<struct<lo:int,hi:int,spans:array<struct<s:int,e:int>>>>"))

    return let(spans, groups)


def overlaps(group: Column, x: Column) -> Column:
    """Whether a span meets one of a group's."""
    return (group["lo"] < x["e"]) & (x["s"] < group["hi"]) & F.exists(group["spans"], lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def small_parts(m: Column) -> Column:
    """Whether all runs of digits are numbers of at most 255."""
    return F.forall(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) <= 3) & (F.lpad(q, 3, "0") <= "255")))


def base_spans(text: Column) -> list[Column]:
    """Per kind: the base spans (s, e, m)."""
    digit = text.rlike("[0-9]")
    guards = (F.contains(text, F.lit("@")), digit & text.rlike(r"[0-9]\.[0-9]"), digit, F.contains(text, F.lit("+")))
    checks: tuple[Callable[[Column], Column], ...] = (
        lambda x: F.lit(True),
        lambda x: small_parts(x["m"]),
        lambda x: F.call_function("luhn_check", digits(x["m"])),
        lambda x: F.length(digits(x["m"])).between(10, 15),
    )
    out = []
    for pattern, guard, check in zip(BASE, guards, checks):
        spans = located(text, pattern)
        out.append(F.when(guard, F.filter(spans, check)).otherwise(F.array().cast(FOUND)))
    return out


def _beside(c: Column) -> Column:
    """Class of the character beside a span: 0 none or blank, 1 letter, 2 digit, 3 other."""
    return F.when((F.length(c) == 0) | c.rlike(r"^\s"), 0).when(c.rlike("^[0-9]"), 2).when(c.rlike(r"^\p{L}"), 1).otherwise(3)


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def unveiled(m: Column) -> Column:
    """An email candidate in its plain form."""
    plain = F.regexp_replace(m, "(?i)" + _AT + r"|\x20at\x20", "@")
    return F.regexp_replace(plain, "(?i)" + _DOT + r"|\x20dot\x20", ".")


def national(m: Column) -> Column:
    """A phone candidate without its country code, as far as that shows."""
    return F.regexp_replace(m, r"^(?:(?:\+|00)?[0-9]{1,3}[\x20.-]?(?=\()|(?:\+|00)[0-9]{1,3}[\x20.-])", "")


def _fits(k: int) -> Callable[[Column], Column]:
    """Whether a match passes the check of kind ``k`` once it is unveiled."""
    return (
        lambda x: unveiled(x["m"]).rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}$"),
        lambda x: small_parts(x["m"]),
        lambda x: F.call_function("luhn_check", digits(x["m"])) & F.length(digits(x["m"])).between(14, 19),
        lambda x: F.length(digits(x["m"])).between(10, 15),
    )[k]


def _described(base: list[Column], by: int) -> Callable[[Column], Column]:
    """From a match of generator ``by`` to a candidate; ``base`` are the groups of the base spans of each kind.

    ``base`` is null in a candidate that meets base spans of other kinds alone: these explain it.
    """
    k = WIDE[by][0]

    def described(x: Column) -> Column:
        left, right = x["l"], x["r"]

        def build(m: Column) -> Column:
            d = digits(m)
            own = {
                "digits": F.least(F.length(d), F.lit(22)),
                "brackets": _flag(m.rlike("[()]")) if k == 3 else F.lit(0),
                "seps": F.least(F.length(F.regexp_replace(m, r"[^\x20./_-]", "")), F.lit(6)) if k == 3 else F.lit(0),
                "labels": F.least(F.size(F.split(m, r"[.]")), F.lit(5)) if k == 0 else F.lit(0),
                "tail": F.least(F.length(F.regexp_extract(m, "[.]([A-Za-z]+)$", 1)), F.lit(7)) if k == 0 else F.lit(0),
                "before": _beside(F.substring(left, -1, 1)),
                "after": _beside(right),
                "cue": _flag(left.rlike(CUES[k])),
                "lead": F.when(d.startswith("0"), 1).otherwise(0) if k > 1 else F.lit(0),
            }
            met = [F.exists(g, lambda y: overlaps(y, x)) for g in base]
            others = [m for i, m in enumerate(met) if i != k]
            label = F.when(met[k], True).when(others[0] | others[1] | others[2], None).otherwise(False)
            return F.struct(F.lit(by).alias("by"), x["s"].alias("s"), x["e"].alias("e"), label.alias("base"), *(own[f].cast("int").alias(f) for f in FEATURES))

        shape = (unveiled, lambda m: m, lambda m: m, national)[k]
        return let(shape(x["m"]), build)

    return described


def candidates(text: Column, base: list[Column]) -> Column:
    """What the generators propose and what passes their kind's check, with features, and whether it meets a base span."""
    digit = text.rlike("[0-9]{2}|[0-9][.\\[(]")
    veiled = text.rlike(r"(?i)[(\[{](?:at|dot|\.)[)\]}]|\x20at\x20[^\x20]+\x20dot\x20")
    guards = (F.contains(text, F.lit("@")), veiled, veiled, digit & text.rlike(r"[0-9][.\[(]"), digit, digit, digit)
    empty = F.array().cast(f"array<{CANDIDATE}>")

    def found(by: int, groups: list[Column]) -> Column:
        spans = F.filter(located(text, WIDE[by][1]), _fits(WIDE[by][0]))
        return F.transform(spans, _described(groups, by)).cast(f"array<{CANDIDATE}>")

    held = F.struct(*(grouped(b).alias(f"g{k}") for k, b in enumerate(base)))

    def whole(groups: Column) -> Column:
        own = [groups[f"g{k}"] for k in range(len(base))]
        return F.concat(*(F.when(guard, found(by, own)).otherwise(empty) for by, guard in enumerate(guards)))

    return F.when(digit | veiled | F.contains(text, F.lit("@")), let(held, whole)).otherwise(empty)


def proposed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of documents, their base spans by kind (b0 to b3), and all candidates."""
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    rows = rows.select("*", F.pmod(F.xxhash64("__text"), F.lit(2)).cast("int").alias("fold"), *(c.alias(f"b{k}") for k, c in enumerate(base_spans(F.col("__text")))))
    return rows.withColumn("candidates", candidates(F.col("__text"), [F.col(f"b{k}") for k in range(4)]))


def _checked(digits: str) -> str:
    """The digits with the one that makes them pass Luhn's check."""
    total = sum(x if i % 2 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits))))
    return digits + str(-total % 10)


def prior(spark: SparkSession, n: int = PRIOR) -> DataFrame:
    """Candidates of ``n`` texts a kind with a base span and as many with a number that is none, as :func:`proposed` gives them.

    Numbers come from a fixed sequence; the words around them are the same for spans and for others.
    """
    around = (("the words ", " and on"), ("", "."), ("see ", ", then"), ("(", ")"), ("line ", ""), ("so: ", " or"))
    state, texts = 1, []

    def digits(count: int) -> str:
        nonlocal state
        out = ""
        for _ in range(count):
            state = (state * 1103515245 + 12345) % 2**31
            out += str(state // 65536 % 10)
        return out

    for i in range(n):
        left, right = around[i % len(around)]
        card = _checked("4" + digits(14))
        own = (
            f"{'abcdefgh'[i % 8]}{digits(2)}@{('mail', 'post', 'web')[i % 3]}{digits(1)}.example.com",
            ".".join(str(int(digits(3)) % 256) for _ in range(4)),
            card if i % 2 else " ".join(card[k : k + 4] for k in range(0, 16, 4)),
            f"+{1 + i % 9} ({2 + i % 8}{digits(2)}) 555-{digits(4)}",
        )
        other = (
            (f"{'abcdefgh'[i % 8]}{digits(2)} at {digits(2)}", "in at and. The")[i % 2],
            ".".join(digits(1) for _ in range(3 + i % 2 * 3)),
            ("4" + digits(15), "-".join(digits(4) for _ in range(4)))[i % 2],
            (f"{1 + i % 9}{digits(9)}", "-".join(digits(4) for _ in range(4)), f"ab{1 + i % 9}{digits(9)}cd", f"{digits(4)}-{digits(2)}-{digits(2)} {digits(4)}")[i % 4],
        )
        texts += [left + x + right for x in (*own, *other)]
    rows = spark.range(1).select(F.explode(F.split(F.lit("\n".join(texts)), "\n")).alias("text"))
    return proposed(rows, []).select("fold", "candidates")


Tree = tuple  # (feature, limit, below, above), where below and above are (feature, limit, low leaf, high leaf) or a leaf


def boosted(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = ROUNDS) -> tuple[float, list[Tree]]:
    """Prior log-odds and trees of depth two, from (features, positive weight, all weight)."""
    total, positive = sum(r[2] for r in rows), sum(r[1] for r in rows)
    start = math.log((positive + 0.5) / (total - positive + 0.5))
    margin = [start] * len(rows)
    trees: list[Tree] = []
    for _ in range(rounds):
        slope, curve = [], []
        for (_, pos, n), z in zip(rows, margin):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            slope.append(pos - n * p)
            curve.append(n * p * (1 - p))
        tree = _grown(rows, slope, curve, range(len(rows)), 2)
        if not isinstance(tree, tuple):
            break
        trees.append(tree)
        margin = [z + _leaf(tree, x) for (x, _, _), z in zip(rows, margin)]
    return start, trees


def _grown(rows: list, slope: list[float], curve: list[float], own: range | list[int], depth: int):
    """A tree over the rows ``own``, or a leaf's value where no split gains."""
    g, h = sum(slope[i] for i in own), sum(curve[i] for i in own)
    best = None
    if depth:
        for f in range(len(rows[0][0])):
            sums: dict[int, list[float]] = {}
            for i in own:
                s = sums.setdefault(rows[i][0][f], [0.0, 0.0])
                s[0] += slope[i]
                s[1] += curve[i]
            a = b = 0.0
            for limit in sorted(sums)[:-1]:
                a, b = a + sums[limit][0], b + sums[limit][1]
                gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                    best = gain, f, limit
    if best is None:
        return RATE * g / (h + 1)
    _, f, limit = best
    low, high = [i for i in own if rows[i][0][f] <= limit], [i for i in own if rows[i][0][f] > limit]
    return f, limit, _grown(rows, slope, curve, low, depth - 1), _grown(rows, slope, curve, high, depth - 1)


def _leaf(tree, x: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def _expression(tree, feature: Callable[[int], Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(feature(tree[0]) <= tree[1], _expression(tree[2], feature)).otherwise(_expression(tree[3], feature))


Part = tuple[float, float, list[Tree], float]  # weight, prior log-odds, trees, threshold in log-odds


class Model:
    """For each kind the parts whose weighted margins decide."""

    def __init__(self, kinds: dict[int, list[Part]]) -> None:
        self.kinds = kinds

    @classmethod
    def fit(cls, found: DataFrame) -> Model:
        """From the candidates of a table of :func:`proposed`, and those of the prior texts."""
        sources = (cls.vectors(found), cls.vectors(prior(found.sparkSession)))
        kinds = {}
        for k in range(len(KINDS)):
            parts, rest = [], 1.0
            for own, weight in zip(sources, (PRIOR_WEIGHT, 0)):
                folds = [[r[2:] for r in own if r[:2] == (k, fold)] for fold in (0, 1)]
                n = min(sum(pos for _, pos, _ in f) for f in folds)
                if n:
                    start, trees = boosted(folds[0])
                    threshold = cls.calibrated([(start + sum(_leaf(t, x) for t in trees), pos) for x, pos, _ in folds[1]])
                    parts.append((rest * n / (n + weight), start, trees, threshold))
                    rest -= parts[-1][0]
            kinds[k] = parts
        return cls(kinds)

    @staticmethod
    def vectors(found: DataFrame) -> list[tuple]:
        """(kind, fold, features, base spans, all) of the distinct feature vectors."""
        kind = F.element_at(F.array(*(F.lit(k) for k, _ in WIDE)), F.col("c.by") + 1)
        rows = found.select("fold", F.explode("candidates").alias("c")).where("c.base is not null")
        rows = rows.select(kind.alias("kind"), "fold", "c.base", *(f"c.{f}" for f in FEATURES))
        grouped = rows.groupBy("kind", "fold", *FEATURES).agg(F.sum(F.col("base").cast("long")).alias("pos"), F.count("*").alias("n"))
        top = grouped.orderBy(F.desc("n"), "kind", "fold", *FEATURES).limit(VECTORS).collect()
        return [(r["kind"], r["fold"], tuple(r[f] for f in FEATURES), float(r["pos"]), float(r["n"])) for r in top]

    @staticmethod
    def calibrated(scored: list[tuple[float, float]]) -> float | None:
        """The log-odds of ``SHARE`` of the mean probability of base spans, from (log-odds, base spans)."""
        count = sum(pos for _, pos in scored)
        if not count:
            return None
        p = SHARE * sum(pos / (1 + math.exp(-max(-30.0, min(30.0, z)))) for z, pos in scored) / count
        return math.log(p / (1 - p))

    def selects(self, c: Column) -> Column:
        """Whether a candidate's score reaches its kind's threshold."""
        out = F.lit(False)
        for kind, parts in self.kinds.items():
            margin = F.lit(0.0)
            for weight, start, trees, threshold in parts:
                total = sum((_expression(t, lambda f: c[FEATURES[f]]) for t in trees), F.lit(float(start)))
                margin = margin + F.lit(float(weight)) * (total - threshold)
            own = c["by"].isin([by for by, (k, _) in enumerate(WIDE) if k == kind])
            out = F.when(own, margin >= -1e-9).otherwise(out)
        return out & (c["base"] == F.lit(False))


def _of_generator(by: int) -> Column:
    """The added spans of a generator that meet none of an earlier one."""
    earlier = grouped(F.filter("added", lambda y: y["by"] < by))
    return let(earlier, lambda groups: F.filter("added", lambda x: (x["by"] == by) & ~F.exists(groups, lambda g: overlaps(g, x))))


def with_spans(found: DataFrame, model: Model) -> DataFrame:
    """``base`` and ``spans``, arrays of (s, k, e) in order, in place of the columns of :func:`proposed`."""
    def marked(k: int) -> Column:
        return F.transform(f"b{k}", lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    base = F.array_sort(F.concat(*map(marked, range(4))))
    rows = found.withColumn("base", base)
    added = F.transform(F.filter("candidates", model.selects), lambda c: F.struct(c["s"].alias("s"), c["by"].alias("by"), c["e"].alias("e")))
    rows = rows.withColumn("added", F.array_sort(added))
    own = [F.filter("added", lambda x: x["by"] == 0), *(_of_generator(by) for by in range(1, len(WIDE)))]
    kinds = F.array(*(F.lit(k) for k, _ in WIDE))
    lone = F.transform(F.concat(*own), lambda x: F.struct(x["s"].alias("s"), F.element_at(kinds, x["by"] + 1).alias("k"), x["e"].alias("e")))
    return rows.withColumn("spans", F.array_sort(F.concat("base", lone))).drop("candidates", "added", "fold")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base spans by kind, and base and all spans of every row of ``docs`` (doc_id, text)."""
    found = proposed(docs, ["doc_id"]).drop("__text")
    found = store(found.select("doc_id", *(F.transform(f"b{k}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(f"b{k}") for k in range(4)), "fold", "candidates"), "pii")
    return with_spans(found, Model.fit(found))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets, and ``n_chars`` of a text so changed, if there
    is such a column, by its new length; null text stays null."""
    slim = docs.select(F.lit(None).cast("long").alias("doc_id"), "text")
    model = Model.fit(store(proposed(slim, []).select("fold", "candidates"), "pii"))
    columns = docs.columns  # kept apart in one struct, so that their names clash with none here
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row"), "text")
    rows = with_spans(proposed(whole, ["__row"]), model)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("__text"), acc["at"] + 1, x["s"] - acc["at"])
        fresh = F.concat(acc["out"], F.array(gap, F.element_at(names, x["k"] + 1)))
        out = F.when(x["s"] >= acc["at"], fresh).otherwise(acc["out"])  # a span that overlaps the last one extends it
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = F.substring(F.col("__text"), F.col("__r.at") + 1, F.char_length("__text"))
    rows = rows.withColumn("__r", F.aggregate("spans", start, step))
    clean = F.when(F.size("spans") == 0, F.col("__row.text")).otherwise(F.concat(F.array_join("__r.out", ""), rest))
    rows = rows.withColumn("__clean", clean)

    def column(c: str) -> Column:
        if c == "text":
            return F.col("__clean").alias(c)
        old = F.col("__row").getField(c)
        return (F.when(F.size("spans") > 0, F.length("__clean").cast(docs.schema[c].dataType)).otherwise(old) if c == "n_chars" else old).alias(c)

    return rows.select(*map(column, columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every text of ``documents``."""
    found = detect(table(spark, sf_dir, "documents"))
    counts = [F.size(f"b{k}").cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
