"""Entity matching: event reports to canonical events, company observations to companies.

Rows that share a key are never paired with each other: each meets the first row of its key, or a summary of the key.
Pairs are formed only where values must be compared, and then inside bands of value and date or among rows that share
rare parts. The two order-dependent steps are leader clustering, in parallel rounds, and the company fold, one ordered
stream per connected component.
"""

from __future__ import annotations

import bisect
import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import text as tx
from leadlake.functions import values as v
from leadlake.operators.joins import by_key, components
from leadlake.session import checkpointed, ship, stored

# --- similarity ---


def name_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two names (not symmetric: observation first, record second); Arrow batches."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def fuzzy_pairs(names: DataFrame, least: float = 0.9) -> DataFrame:
    """(a, b, ratio) of names (id, name) with a ratio of at least `least`, earlier id first; candidates share one of
    the rarest trigrams of both names.

    Names of lengths L and M have K = ratio (L + M) / 2 matched characters in at most U + 1 blocks, where U = L + M - 2 K
    are left over; blocks of K characters hold at least K - 2 (U + 1) trigram places. The least of that over all M gives
    the trigrams that must be shared, less those that the name repeats; a name's rarest k - need + 1 of k trigrams must
    then meet the other's, and of k - need + 2 two must, if it needs two. Names that need two meet on two trigrams at once,
    so a frequent one makes no list; the few short names that need one meet the others on one. Trigrams of normal forms
    number at most 37^3, which bounds the table of counts.
    """
    ship(names.sparkSession)
    n = F.length("name")
    places = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(F.col("name"), i, F.lit(3)))
    grams = F.when(n >= 3, F.array_distinct(places)).otherwise(F.array("name"))
    rows = names.filter("name <> ''").withColumn("g", grams)
    counts = rows.select(F.explode("g").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    own = rows.select("id", "name", F.size("g").alias("k"), F.explode("g").alias("t")).join(counts, "t")

    def shared(m: Column) -> Column:
        over = F.floor((1 - least) * (n + m) + 1e-9)
        over = over - F.pmod(over + n + m, F.lit(2))  # as odd as both lengths together
        return F.when(over >= 0, (n + m - over) / 2 - 2 * (over + 1))

    lengths = F.sequence(F.ceil(n * least / (2 - least) - 1e-9).cast("int"), F.floor(n * (2 - least) / least + 1e-9).cast("int"))
    need = (F.array_min(F.transform(lengths, shared)) - F.greatest(n - 2 - F.col("k"), F.lit(0))).cast("int")
    order = own.groupBy("id", "name", "k").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))  # one name's trigrams
    order = checkpointed(order.withColumn("need", F.greatest(need, F.lit(1))))
    rarest = lambda more: F.transform(F.slice("o", F.lit(1), F.col("k") - F.col("need") + more), lambda x: x["t"])

    def side(df: DataFrame, sign: Column, end: str) -> DataFrame:
        return df.select(F.col("id").alias(end), F.col("name").alias(f"n{end}"), F.explode(sign).alias("t"))

    most = F.array_sort(rarest(2))
    twos = F.flatten(F.transform(most, lambda x: F.transform(F.filter(most, lambda y: y > x), lambda y: F.concat(x, y))))
    long, short = order.filter("need > 1"), order.filter("need = 1")
    fits = 2 * F.least(F.length("na"), F.length("nb")) >= least * (F.length("na") + F.length("nb"))
    both = side(long, twos, "a").join(side(long, twos, "b"), "t").filter("a < b")
    one = side(short, rarest(1), "a").join(side(order, rarest(1), "b"), "t").filter("a <> b")  # the smaller id first again
    flip = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y))
    one = one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), flip("na", "nb").alias("na"), flip("nb", "na").alias("nb"))
    pairs = both.filter(fits).select("a", "b", "na", "nb").unionByName(one.filter(fits)).distinct()
    return pairs.withColumn("ratio", name_ratio(F.col("nb"), F.col("na"))).filter(F.col("ratio") >= least).select("a", "b", "ratio")


# --- events ---


def fingerprints(reports: DataFrame) -> DataFrame:
    """(seq, identifiers, buyer, company, value, event_date) in normal form."""
    return reports.select(
        F.col("report_id").alias("seq"), F.filter(F.array(tx.identifier(F.col("reference"))), lambda x: x.isNotNull()).alias("identifiers"),
        tx.party_name(F.col("buyer")).alias("buyer"), tx.party_name(F.col("company")).alias("company"), "value", "event_date",
    )


def identifier_keys(prints: DataFrame) -> DataFrame:
    """(seq, k): the strong identifiers of reports."""
    return prints.select("seq", F.explode("identifiers").alias("k")).distinct()


def identifier_edges(prints: DataFrame) -> DataFrame:
    """(a, b, confidence): each report b with the first report a of one of its strong identifiers."""
    keys = stored(identifier_keys(prints))
    first = checkpointed(keys.groupBy("k").agg(F.min("seq").alias("a"), F.count("*").alias("_rows")))
    star = by_key(keys, first, ["k"], keys.count())
    return star.filter("a < seq").select("a", F.col("seq").alias("b")).distinct().withColumn("confidence", F.lit(0.98))


def composite_classes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports with buyer and company and with a value or a date: (seq, k), with k a hash of these four (128 bits), and a
    row for each k: (k, a, g, value, event_date, _rows), with its first report a and a hash g of buyer and company (128
    bits). Reports of one k agree with each other and with the same others."""
    part = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    sign = lambda *fields: F.unhex(F.md5(F.concat_ws("\u0001", *map(part, fields))))
    known = prints.filter("buyer is not null and company is not null and (value is not null or event_date is not null)")
    rows = stored(known.select("seq", sign("buyer", "company", "value", "event_date").alias("k"), sign("buyer", "company").alias("g"), "value", "event_date"))
    first = rows.groupBy("k").agg(F.min("seq").alias("a"), *(F.first(c).alias(c) for c in ("g", "value", "event_date")), F.count("*").alias("_rows"))
    return rows.select("seq", "k"), stored(first)


#: Days and bands of value (2 %) in a cell: one row in ten has neighbours in the next day cell, one in four in another value cell.
DAYS, BANDS = 32, 8


def composite_links(first: DataFrame) -> DataFrame:
    """(a, b), a < b: first reports of classes (see `composite_classes`) with equal buyer and company whose values and dates
    agree where both are present, at least one of them. They meet in cells of DAYS days and BANDS bands of value; a class
    enters a second cell only where it lies at the edge, so that a pair meets once and few rows are repeated."""
    day, size = F.datediff("event_date", F.lit("1970-01-01").cast("date")), F.abs(F.col("value").cast("double"))
    x = first.select("a", "g", "value", "event_date", day.alias("d"), F.when(size > 0, F.floor(F.log(size) / 0.0203)).when(size == 0, F.lit(-(1 << 40))).alias("v"))
    x = x.withColumns({"dc": F.floor(F.col("d") / DAYS), "vc": F.floor(F.col("v") / BANDS)})
    values = v.value_close(F.col("value_a"), F.col("value_b"))
    dates = v.date_close(F.col("event_date_a"), F.col("event_date_b"))
    agree = F.coalesce(values, F.lit(True)) & F.coalesce(dates, F.lit(True)) & (values.isNotNull() | dates.isNotNull())
    whole = lambda c: F.struct(c.alias("c"), F.lit(True).alias("home"))
    other = lambda cond, c: F.when(cond, F.struct(c.alias("c"), F.lit(False).alias("home")))
    days, bands = F.pmod("d", F.lit(DAYS)), F.pmod("v", F.lit(BANDS))
    later, sooner = other(days >= DAYS - 3, F.col("dc") + 1), other(days < 3, F.col("dc") - 1)
    above, below = other(bands == BANDS - 1, F.col("vc") + 1), other(bands == 0, F.col("vc") - 1)

    def met(left: DataFrame, right: DataFrame, cells: dict[str, Column], once: Column) -> DataFrame:
        for c, where in cells.items():
            right = right.withColumn(f"_{c}", F.explode(F.filter(where, lambda z: z.isNotNull()))).withColumns({c: F.col(f"_{c}.c"), f"{c}_home": F.col(f"_{c}.home")})
        one = lambda df, side, *more: df.select("g", *cells, *more, *(F.col(c).alias(f"{c}_{side}") for c in ("a", "value", "event_date")))
        found = one(left, "a").join(one(right, "b", *(f"{c}_home" for c in cells)), ["g", *cells])
        return found.filter((F.col("a_a") < F.col("a_b")) | once).filter(agree & (F.col("a_a") != F.col("a_b"))).select(F.least("a_a", "a_b").alias("a"), F.greatest("a_a", "a_b").alias("b"))

    valued, dated = F.col("value").isNotNull(), F.col("event_date").isNotNull()
    both = x.filter(valued & dated)
    # the earlier of two neighbouring day cells goes to the later one: such a pair meets there only
    links = met(both, both, {"dc": F.array(whole(F.col("dc")), later), "vc": F.array(whole(F.col("vc")), above, below)}, ~F.col("dc_home"))
    for part, partners, cell, near, lacks in ((valued & ~dated, valued, "vc", (above, below), "event_date_b"), (dated & ~valued, dated, "dc", (later, sooner), "value_b")):
        if x.filter(part).head(1):
            links = links.unionByName(met(x.filter(part), x.filter(partners), {cell: F.array(whole(F.col(cell)), *near)}, F.col(lacks).isNotNull()))
    return links


def _class_edges(classes: DataFrame, links: DataFrame, confidence: float) -> DataFrame:
    """(a, b, confidence): each report with the first of its class, and the first ones of linked classes with each other:
    as many rows as reports and links of classes, however many reports a class has."""
    first = checkpointed(classes.groupBy("k").agg(F.min("seq").alias("a"), F.count("*").alias("_rows")))
    star = by_key(classes.select("seq", "k"), first, ["k"], classes.count()).filter("a < seq").select("a", F.col("seq").alias("b"))
    ends = first.select("k", "a")
    across = links.filter("k < k2").join(ends, "k").join(ends.select(F.col("k").alias("k2"), F.col("a").alias("b")), "k2").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return star.unionByName(across).withColumn("confidence", F.lit(confidence))


def _members(rows: DataFrame, first: DataFrame) -> DataFrame:
    """(seq, a): reports with the first one of their class."""
    return by_key(rows, first.select("k", "a", "_rows"), ["k"], first.agg(F.sum("_rows")).first()[0] or 0).select("seq", "a")


def composite_edges(prints: DataFrame) -> DataFrame:
    """(a, b, confidence) of reports that agree in buyer, company, value and date: representatives and their classes."""
    rows, first = composite_classes(prints)
    star = _members(rows, first).filter("a < seq").select("a", F.col("seq").alias("b"))
    return star.unionByName(composite_links(first)).withColumn("confidence", F.lit(0.9))


def semantic_classes(prints: DataFrame, texts: DataFrame) -> DataFrame:
    """(seq, k): reports with a company or a buyer and a text with a token, by a hash of company, buyer and text (128
    bits): reports of one class are alike."""
    j = prints.join(texts.select("seq", "text"), "seq").filter(F.coalesce("company", "buyer").isNotNull() & F.lower("text").rlike("[a-z0-9]"))
    part = lambda c: F.coalesce(F.concat(F.lit("+"), c), F.lit("-"))
    return j.select("seq", F.md5(F.concat_ws("\u0001", part("company"), part("buyer"), part("text"))).alias("k"), "company", "buyer", "text")


def semantic_pairs(classes: DataFrame, least: float = 0.86, name_least: float = 0.6) -> DataFrame:
    """(k, k2), k < k2: classes whose texts have a cosine of `least` or more and whose companies or buyers have a name ratio
    of `name_least` or more.

    Texts of one hashed embedding are alike, so embeddings are compared, each once, and texts only stand for them in the
    result. Candidates share two of the rarest buckets of both embeddings. An embedding's rarest buckets go on until what
    is left of its vector, together with any one of them, is too short to reach the cosine; one that reaches it in one
    bucket alone stands under that bucket. So a list holds the embeddings of two buckets out of 128, not of one; they are
    compared where they meet, and only pairs that reach the cosine are moved."""
    ship(classes.sparkSession)
    entries = F.array_sort(F.transform(F.map_entries(v.hashed_counts(F.col("text"))), lambda x: F.struct(x["key"].alias("bucket"), x["value"].alias("n"))))
    one = classes.groupBy("k").agg(F.first("company").alias("company"), F.first("buyer").alias("buyer"), F.first("text").alias("text")).withColumn("o", entries)
    one = stored(one.select("k", "company", "buyer", "o", F.unhex(F.md5(F.col("o").cast("string"))).alias("e")))
    vectors = stored(one.groupBy("e").agg(F.first("o").alias("o")))
    posts = vectors.select("e", F.explode("o").alias("x")).select("e", "x.*")
    often = posts.groupBy("bucket").agg(F.count("*").alias("df"))  # at most 128 rows
    square = lambda x: x["n"] * x["n"]
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + square(x))
    ordered = posts.join(F.broadcast(often), "bucket").groupBy("e").agg(F.array_sort(F.collect_list(F.struct("df", "bucket", "n"))).alias("o")).withColumn("norm", total(F.col("o")))
    enough = (least * least - 1e-9) * F.col("norm")

    def reaches(i: Column) -> Column:
        """Whether the buckets from place i on, with the largest one before it, may reach the cosine."""
        before = F.slice("o", 1, i)
        return total(F.slice("o", i + 1, F.size("o"))) + F.coalesce(F.array_max(F.transform(before, square)), F.lit(0)) >= enough

    heads = ordered.select("e", "o", "norm", F.filter("o", lambda x, i: reaches(i)).alias("p"))
    names = F.array_sort(F.transform("p", lambda x: x["bucket"].cast("long")))
    twos = F.flatten(F.transform(names, lambda x: F.transform(F.filter(names, lambda y: y > x), lambda y: x * 1000 + y)))
    # one bucket that reaches the cosine by itself: such texts can share it alone
    ones = F.transform(F.filter("o", lambda x: square(x) >= (least * least - 1e-9) * F.col("norm")), lambda x: -x["bucket"].cast("long") - 1)
    told = F.map_from_entries(F.transform("o", lambda x: F.struct(x["bucket"], x["n"])))
    heads = stored(heads.select("e", told.alias("m"), "norm", F.explode(F.concat(twos, ones)).alias("sign")))
    # a few thousand rows here make millions of pairs: Spark would leave them to one task, as it goes by bytes
    spread = lambda df, *on: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)
    met = spread(heads, "e").join(heads.select("sign", *(F.col(c).alias(f"{c}2") for c in ("e", "m", "norm"))), "sign").filter("e < e2")
    dot = F.aggregate(F.map_entries("m"), F.lit(0.0), lambda a, x: a + x["value"] * F.coalesce(F.try_element_at("m2", x["key"]), F.lit(0)))
    near = met.filter(dot / (F.sqrt("norm") * F.sqrt("norm2")) >= least).select("e", "e2").distinct()
    near = near.unionByName(vectors.select("e", F.col("e").alias("e2")))
    side = lambda k, e: one.select(F.col("e").alias(e), *(F.col(c).alias(f"{k}_{c}") for c in ("k", "company", "buyer")))
    alike = spread(near.join(side("a", "e"), "e"), "e2").join(side("b", "e2"), "e2").filter((F.col("e") != F.col("e2")) | (F.col("a_k") < F.col("b_k")))
    # names are compared in the order of the classes, as the ratio is not symmetric; equal ones need no comparison
    turned = F.col("a_k") > F.col("b_k")
    pick = lambda first, second, c: F.when(turned, F.col(f"{second}_{c}")).otherwise(F.col(f"{first}_{c}")).alias(f"{first}{c}")
    alike = alike.select(*(pick(x, y, c) for x, y in (("a", "b"), ("b", "a")) for c in ("k", "company", "buyer")))
    equal = F.coalesce(F.col("acompany") == F.col("bcompany"), F.lit(False)) | F.coalesce(F.col("abuyer") == F.col("bbuyer"), F.lit(False))
    ratio = lambda c: F.coalesce(name_ratio(F.col(f"b{c}"), F.col(f"a{c}")), F.lit(0.0))
    pairs = lambda df: df.select(F.col("ak").alias("k"), F.col("bk").alias("k2"))
    # pairs with an equal name, most of them, are joined by themselves and never go through Python
    return pairs(alike.filter(equal)).unionByName(pairs(alike.filter(~equal).withColumn("r", F.greatest(ratio("company"), ratio("buyer"))).filter(F.col("r") >= name_least)))


def semantic_links(classes: DataFrame, least: float = 0.86, name_least: float = 0.6) -> DataFrame:
    """The pairs of `semantic_pairs` in both directions."""
    pairs = stored(semantic_pairs(classes, least, name_least))
    return pairs.unionByName(pairs.select(F.col("k2").alias("k"), F.col("k").alias("k2")))


def semantic_edges(prints: DataFrame, texts: DataFrame, least: float = 0.86, name_least: float = 0.6) -> DataFrame:
    """(a, b, confidence) of reports with alike texts and companies or buyers: representatives and their classes. Dates
    play no part."""
    classes = stored(semantic_classes(prints, texts))
    return _class_edges(classes, semantic_pairs(classes, least, name_least), 0.85)


def best_matches(prints: DataFrame) -> DataFrame:
    """(seq, best, confidence): of each report the match of most confidence among all earlier ones, by identifiers and by
    buyer, company, value and date; the earliest of equals."""
    rows, first = composite_classes(prints)
    near = composite_links(first).groupBy(F.col("b").alias("a")).agg(F.min("a").alias("near"))
    earliest = stored(first.select("k", "a", "_rows").join(near, "a", "left").select("k", F.coalesce("near", "a").alias("a"), "_rows"))
    found = _members(rows, earliest).filter("a < seq").select("a", F.col("seq").alias("b"), F.lit(0.9).alias("confidence"))
    best = identifier_edges(prints).unionByName(found).groupBy(F.col("b").alias("seq"))
    return best.agg(F.max_by("a", F.struct("confidence", -F.col("a"))).alias("best"), F.max("confidence").alias("confidence"))


def candidate_counts(prints: DataFrame) -> DataFrame:
    """(seq, candidates, first): how many other reports share the date, the company or the identifier of a report, and
    the earliest of them, itself included. Counted by inclusion and exclusion over the blocks, without a pair."""
    x = prints.select("seq", "event_date", "company", F.get("identifiers", F.lit(0)).alias("i"))
    x = stored(x)
    total, keys = x.count(), ("event_date", "company", "i")
    out = x
    for n in range(1, 8):
        on = [k for b, k in enumerate(keys) if n >> b & 1]
        name = "_" + "".join(str(b) for b in range(3) if n >> b & 1)
        full = x.dropna(subset=on)
        block = checkpointed(full.groupBy(*on).agg(F.count("*").alias(name), F.min("seq").alias(f"{name}m"), F.count("*").alias("_rows")))
        known = by_key(full.select("seq", *on), block, on, total).select("seq", name, f"{name}m")
        out = out.join(known, "seq", "left")
    size = lambda *names: sum((F.coalesce(f"_{n}", F.lit(0)) for n in names), F.lit(0))
    number = size("0", "1", "2") - size("01", "02", "12") + size("012")
    return out.select("seq", F.greatest(number - 1, F.lit(0)).cast("long").alias("candidates"), F.least(F.col("seq"), "_0m", "_1m", "_2m").alias("first"))


def leaders(items: DataFrame, edges: DataFrame | None = None, decided: DataFrame | None = None, groups: tuple[tuple[DataFrame, DataFrame | None, float], ...] = ()) -> DataFrame:
    """(seq, canonical, confidence): what a sequential pass gives that links every item to its best earlier canonical
    item or makes it canonical, found in parallel rounds (the lexicographically first maximal independent set; Blelloch,
    Fineman and Shun, SPAA 2012). edges: (a, b, confidence) with a < b. groups: (members (seq, k), alike (k, k2) or
    None, confidence): all members of a key, and of alike keys, match each other; they are never paired. decided:
    canonical items of earlier runs.

    In a round an undecided item without an earlier match that is undecided or canonical becomes canonical; one with an
    earlier canonical match is linked. Of a key, the earliest canonical and the earliest undecided member tell that for
    all others. Rounds are as many as the longest chain of decisions in which each waits for the one before; a set of
    reports of one event takes two, whatever its size.
    """
    groups = tuple((stored(m.select("seq", "k")), None if alike is None else stored(alike.select("k", "k2")), c) for m, alike, c in groups)
    edges = checkpointed(edges) if edges is not None else None
    totals = [m.count() for m, _, _ in groups]
    touched = [m.select("seq") for m, _, _ in groups] + ([edges.select(F.explode(F.array("a", "b")).alias("seq"))] if edges is not None else [])
    touched = reduce(DataFrame.unionByName, touched).distinct()
    start = F.lit("?") if decided is None else F.when(F.col("_d").isNotNull(), "canonical").otherwise("?")
    state = touched if decided is None else touched.join(decided.select("seq", F.lit(1).alias("_d")), "seq", "left")
    state = checkpointed(state.select("seq", start.alias("state")))

    def of_keys(members: DataFrame, alike: DataFrame | None, total: int, state: DataFrame, rows: DataFrame) -> DataFrame:
        """(seq, done, open) of rows: the earliest canonical and the earliest undecided member of their key or alike ones."""
        known = members.join(state, "seq")
        first = known.groupBy("k").agg(F.min(F.when(F.col("state") == "canonical", F.col("seq"))).alias("done"), F.min(F.when(F.col("state") == "?", F.col("seq"))).alias("open"), F.count("*").alias("_rows"))
        if alike is not None:
            near = alike.join(first.select(F.col("k").alias("k2"), "done", "open"), "k2").select("k", "done", "open", F.lit(0).cast("long").alias("_rows"))
            first = first.unionByName(near).groupBy("k").agg(F.min("done").alias("done"), F.min("open").alias("open"), F.sum("_rows").alias("_rows"))
        return by_key(rows, checkpointed(first), ["k"], total).select("seq", "done", "open")

    while state.filter("state = '?'").head(1):
        waiting = state.filter("state = '?'").select("seq")
        told = []
        if edges is not None:
            e = edges.join(state.select(F.col("seq").alias("a"), F.col("state").alias("sa")), "a").join(waiting.withColumnRenamed("seq", "b"), "b", "left_semi")
            told.append(e.select(F.col("b").alias("seq"), (F.col("sa") == "canonical").alias("near"), (F.col("sa") == "?").alias("open")))
        for (members, alike, _), total in zip(groups, totals):
            k = of_keys(members, alike, total, state, members.join(waiting, "seq", "left_semi"))
            told.append(k.select("seq", F.coalesce(F.col("done") < F.col("seq"), F.lit(False)).alias("near"), F.coalesce(F.col("open") < F.col("seq"), F.lit(False)).alias("open")))
        earlier = reduce(DataFrame.unionByName, told).groupBy("seq").agg(F.max("near").alias("near"), F.max("open").alias("open"))
        new = F.when(F.col("state") != "?", F.col("state")).when(F.coalesce("near", F.lit(False)), "linked").when(~F.coalesce("open", F.lit(False)), "canonical").otherwise("?")
        state = checkpointed(state.join(earlier, "seq", "left").select("seq", new.alias("state")))
    linked = state.filter("state = 'linked'").select("seq")
    found = []
    if edges is not None:
        canonical = state.filter("state = 'canonical'").select(F.col("seq").alias("a"))
        found.append(edges.join(canonical, "a").select(F.col("b").alias("seq"), "a", "confidence"))
    for (members, alike, confidence), total in zip(groups, totals):
        k = of_keys(members, alike, total, state, members.join(linked, "seq", "left_semi"))
        found.append(k.filter("done < seq").select("seq", F.col("done").alias("a"), F.lit(confidence).alias("confidence")))
    best = reduce(DataFrame.unionByName, found).groupBy("seq").agg(F.max_by(F.struct("a", "confidence"), F.struct("confidence", -F.col("a"))).alias("x"))
    out = linked.join(best, "seq").select("seq", F.col("x.a").alias("canonical"), F.col("x.confidence").alias("confidence"))
    return items.select("seq").join(out, "seq", "left").select("seq", F.coalesce("canonical", "seq").alias("canonical"), "confidence")


def canonicalise(prints: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(seq, canonical, confidence) by shared identifiers, then buyer, company, value and date, then alike texts."""
    rows, first = composite_classes(prints)
    links = stored(composite_links(first))
    both = links.select(F.col("a").alias("k"), F.col("b").alias("k2")).unionByName(links.select(F.col("b").alias("k"), F.col("a").alias("k2")))
    groups = [(identifier_keys(prints), None, 0.98), (_members(rows, first).select("seq", F.col("a").alias("k")), both, 0.9)]
    if texts is not None:
        classes = stored(semantic_classes(prints, texts))
        groups.append((classes.select("seq", "k"), semantic_links(classes), 0.85))
    return leaders(prints.select("seq"), groups=tuple(groups))


def canonical_events(reports: DataFrame, links: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """One row per canonical event with all its evidence: reports, values, first and last day, and, with companies
    (seq, company_id), the company of its earliest report that has one. Nothing is dropped."""
    j = reports.join(links, reports.report_id == links.seq)
    more = []
    if companies is not None:
        j = j.join(companies.select("seq", F.col("company_id").alias("_c")), "seq", "left")
        more = [F.min(F.when(F.col("_c").isNotNull(), F.struct("seq", "_c")))["_c"].alias("company_id")]
    return j.groupBy("canonical").agg(F.count("*").alias("sources"), F.min("event_date").alias("first_seen"), F.max("event_date").alias("last_seen"), F.array_sort(F.collect_set("value")).alias("reported_values"), *more)


# --- companies ---

KEYS = (("cin", 0.99), ("gstin", 0.98), ("pan", 0.95), ("domain", 0.90))


def company_forms(observations: DataFrame) -> DataFrame:
    """(obs_id, core, full, display, cin, gstin, pan, domain, city, state) in normal form."""
    key = lambda c: tx.empty_to_null(F.upper(F.trim(c)))
    name = F.col("raw_name")
    return observations.select(
        "obs_id", tx.empty_to_null(tx.company_core(name)).alias("core"), tx.company_full(name).alias("full"), tx.company_display(name).alias("display"),
        key("cin").alias("cin"), key("gstin").alias("gstin"), key("pan").alias("pan"), tx.domain(F.col("website")).alias("domain"), tx.empty_to_null(F.lower(F.trim("city"))).alias("city"), tx.empty_to_null(F.lower(F.trim("state"))).alias("state"),
    )


#: Registration ids: two observations that both have one of a kind must have the same.
IDS = ("cin", "gstin", "pan")


def _kinds(forms: DataFrame, keys: dict[str, Column], *more: str) -> DataFrame:
    """(obs_id, more, kind, value): a row for each key that an observation has."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in keys.items())))
    return forms.select("obs_id", *more, kinds.alias("x")).select("obs_id", *more, "x.*").dropna(subset=["value"])


def earliest_compatible(forms: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(obs_id, kind, a): for each kind of key, each observation with the earliest one of all that have its key and no
    other registration id, where that is an earlier one.

    A null id agrees with every other, so compatibility is not transitive and no row stands for a whole key. Observations
    of one key and the same ids are a class. A class is entered into a table of least ids under each of the 8 patterns
    of its ids, a pattern having an id as it is (or none) or any; it then looks up the patterns that agree with it: an id
    that it has, as such and as none, and one that it lacks, as any. So there is no pair of rows or classes of a key."""
    on = ["kind", "value"]
    rows = _kinds(forms.withColumns({f"_{k}": F.col(k) for k in IDS}), keys, *(f"_{k}" for k in IDS))
    ids = [f"_{k}" for k in IDS]
    own = {k: F.coalesce(F.concat(F.lit("="), k), F.lit("-")) for k in ids}
    rows = checkpointed(rows.withColumns(own))
    classes = checkpointed(rows.groupBy(*on, *ids).agg(F.min("obs_id").alias("first"), F.count("*").alias("_rows")))

    def patterns(options: dict[str, Column]) -> DataFrame:
        found = classes
        for k in ids:
            found = found.withColumn(f"{k}p", F.explode(options[k]))
        return found

    key = [*on, *(f"{k}p" for k in ids)]
    held = patterns({k: F.array(F.col(k), F.lit("*")) for k in ids}).select(*key, "first", F.lit(0).alias("_asks"))
    asked = patterns({k: F.when(F.col(k) == "-", F.array(F.lit("*"))).otherwise(F.array(F.col(k), F.lit("-"))) for k in ids})
    both = held.unionByName(asked.select(*key, F.lit(None).cast(dict(classes.dtypes)["first"]).alias("first"), F.lit(1).alias("_asks")))
    table = checkpointed(both.groupBy(*key).agg(F.min("first").alias("a"), F.sum("_asks").alias("_rows")).filter("a is not null and _rows > 0"))
    found = by_key(asked.select(*on, *ids, *(f"{k}p" for k in ids)), table, key, table.agg(F.sum("_rows")).first()[0] or 0)
    sizes = classes.select(*on, *ids, "_rows")
    best = checkpointed(found.groupBy(*on, *ids).agg(F.min("a").alias("a")).join(sizes, [*on, *ids]))
    return by_key(rows, best, [*on, *ids], rows.count()).filter("a < obs_id").select("obs_id", "kind", "a")


def _best(found: DataFrame, confidence: dict[str, float]) -> DataFrame:
    """(a, b, kind, confidence): of each observation b the match of most confidence, the earliest of equals."""
    weight = F.create_map(*(F.lit(x) for kv in confidence.items() for x in kv))
    best = found.withColumn("confidence", weight[F.col("kind")]).groupBy(F.col("obs_id").alias("b")).agg(F.max(F.struct("confidence", (-F.col("a")).alias("n"), "kind")).alias("x"))
    return best.select((-F.col("x.n")).alias("a"), "b", "x.kind", "x.confidence")


def key_matches(forms: DataFrame) -> DataFrame:
    """(a, b, kind, confidence): the best match of b among all earlier observations that share a registration id or the
    domain with it and conflict in no id."""
    return _best(earliest_compatible(forms, {k: F.col(k) for k, _ in KEYS}), dict(KEYS))


def name_matches(forms: DataFrame) -> DataFrame:
    """(a, b, confidence): the best match of b among all earlier observations of its core name that conflict in no id: 0.92
    where the city or the state is the same, 0.85 otherwise."""
    placed = lambda c: F.concat("core", F.lit("\u0000"), c)  # noqa: E731  null where there is no place
    keys = {"city": placed("city"), "state": placed("state"), "core": F.col("core")}
    return _best(earliest_compatible(forms, keys), {"city": 0.92, "state": 0.92, "core": 0.85}).drop("kind")


def conflicts(forms: DataFrame) -> DataFrame:
    """(a, b): each observation b that has the core name, but not the registration id of another one, with the earliest
    such a of each kind of id. Of a name, the first holders of its two earliest ids tell that for all rows."""
    rows = checkpointed(_kinds(forms, {k: F.col(k) for k in IDS}, "core").dropna(subset=["core"]))
    values = checkpointed(rows.groupBy("core", "kind", "value").agg(F.min("obs_id").alias("id"), F.count("*").alias("n")))
    first = checkpointed(values.groupBy("core", "kind").agg(F.min(F.struct("id", "value")).alias("one"), F.count("*").alias("_rows"), F.sum("n").alias("n")).filter("_rows > 1"))
    others = by_key(values.select("core", "kind", "value", "id"), first.select("core", "kind", "one", "_rows"), ["core", "kind"], values.count())
    second = others.filter("value <> one.value").groupBy("core", "kind").agg(F.min("id").alias("two"))
    told = checkpointed(first.select("core", "kind", "one", F.col("n").alias("_rows")).join(second, ["core", "kind"]))
    other = F.when(F.col("value") == F.col("one.value"), F.col("two")).otherwise(F.col("one.id"))
    return by_key(rows, told, ["core", "kind"], rows.count()).select(other.alias("a"), F.col("obs_id").alias("b")).distinct()


#: What makes an observation a candidate for another one.
BLOCKS = ("cin", "gstin", "pan", "domain", "core", "full")


def candidates(forms: DataFrame) -> DataFrame:
    """(obs_id, kind, block, holders): the blocks of each observation, a block being all observations with one value of a
    registration id, domain, core or full name, called by the earliest of them. Two observations are candidates for each
    other if and only if they share a block; blocks of one are left out."""
    rows = checkpointed(_kinds(forms, {k: F.col(k) for k in BLOCKS}))
    blocks = checkpointed(rows.groupBy("kind", "value").agg(F.min("obs_id").alias("block"), F.count("*").alias("holders")).filter("holders > 1").withColumn("_rows", F.col("holders")))
    return by_key(rows, blocks, ["kind", "value"], rows.count()).select("obs_id", "kind", "block", "holders")


def key_groups(forms: DataFrame) -> DataFrame:
    """(obs_id, grp): connected components of observations that share any key; each is tied to the first of its blocks."""
    ties = candidates(forms).filter("obs_id <> block").select(F.col("obs_id").alias("a"), F.col("block").alias("b"))
    found = components(ties)
    return forms.select("obs_id").join(found.withColumnRenamed("id", "obs_id"), "obs_id", "left").select("obs_id", F.coalesce("component", "obs_id").alias("grp"))


class _Companies:
    """The companies of one key group as they are made, found by key in constant time."""

    def __init__(self):
        self.made: list[dict] = []
        self.by: dict[tuple, dict[str | None, list[int]]] = {}  # (key, value) -> company's cin -> companies, in order

    def _put(self, n: int, key: str, value: str | None) -> None:
        if value:
            bisect.insort(self.by.setdefault((key, value), {}).setdefault(self.made[n]["cin"], []), n)

    def first(self, r: dict, key: str, value: str | None) -> int | None:
        """The earliest company with a key whose registration ids do not differ from those of a row."""
        known = self.by.get((key, value)) if value else None
        if not known:
            return None
        lists = known.values() if not r["cin"] else [known[c] for c in (r["cin"], None) if c in known]
        agree = lambda n: not any(r[k] and self.made[n][k] and r[k] != self.made[n][k] for k in IDS)
        return min((n for n in (next(filter(agree, x), None) for x in lists) if n is not None), default=None)

    def named(self, r: dict, key: str, value: str | None):
        """All companies with a name, in order, whose registration ids do not differ from those of a row."""
        known = self.by.get((key, value), {}) if value else {}
        lists = list(known.values()) if not r["cin"] else [known[c] for c in (r["cin"], None) if c in known]
        return (n for n in heapq.merge(*lists) if not any(r[k] and self.made[n][k] and r[k] != self.made[n][k] for k in IDS))

    def add(self, r: dict) -> int:
        n = len(self.made)
        self.made.append({k: None for k in (*IDS, "domain", "city", "state", "core")} | {"id": r["obs_id"], "aliases": set()})
        self.learn(n, r)
        self.made[n]["core"] = r["core"]
        self._put(n, "core", r["core"])
        return n

    def learn(self, n: int, r: dict) -> None:
        """Fill what the company lacks and add the name; an id that it gets moves it in the index."""
        c = self.made[n]
        if r["cin"] and not c["cin"]:
            c["cin"] = r["cin"]
            keys = [(k, c[k]) for k in ("gstin", "pan", "domain") if c[k]] + [("full", x) for x in c["aliases"]] + ([("core", c["core"])] if c["core"] else [])
            for key in keys:
                rows = self.by[key][None]
                del rows[bisect.bisect_left(rows, n)]
                self._put(n, *key)
            self._put(n, "cin", c["cin"])
        for k in ("gstin", "pan", "domain"):
            if r[k] and not c[k]:
                c[k] = r[k]
                self._put(n, k, c[k])
        c["city"], c["state"] = c["city"] or r["city"], c["state"] or r["state"]
        if r["full"] not in c["aliases"]:
            c["aliases"].add(r["full"])
            self._put(n, "full", r["full"])


def _fold(made: _Companies, r: dict) -> tuple[int, float | None]:
    """Company and confidence of the next observation: the best match so far, the earliest of equals, or a new company.
    A name counts only where no key agrees; in one place (0.92) it is worth more than a domain (0.90)."""
    weight, n = next(((w, n) for k, w in KEYS[:3] if (n := made.first(r, k, r[k])) is not None), (0.0, None))
    if n is None:
        alike = heapq.merge(made.named(r, "core", r["core"]), made.named(r, "full", r["full"])) if r["core"] else ()
        for m in alike:
            c = made.made[m]
            if r["domain"] and r["domain"] == c["domain"]:
                continue
            if any(r[k] and r[k] == c[k] for k in ("city", "state")):
                weight, n = 0.92, m
                break
            if n is None:
                weight, n = 0.85, m
        if weight < 0.9 and (m := made.first(r, "domain", r["domain"])) is not None:
            weight, n = 0.9, m
    if n is None:
        n = made.add(r)
    else:
        made.learn(n, r)
    return made.made[n]["id"], weight or None


def resolve(forms: DataFrame) -> DataFrame:
    """(obs_id, company_id, confidence): the ordered fold that merges an observation into the best company so far, or
    makes a new one, with ids and aliases that grow as observations merge. Observations of different key groups cannot
    influence each other, so each group is folded by itself, as a stream in the order of its ids; a task holds the
    companies of one group, never its rows."""
    ship(forms.sparkSession)
    grouped = forms.join(key_groups(forms), "obs_id")

    def run(batches):
        group, made = None, _Companies()
        for pdf in batches:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            out = []
            for r in pdf.to_dict("records"):
                if r["grp"] != group:
                    group, made = r["grp"], _Companies()
                out.append((r["obs_id"], *_fold(made, r)))
            yield pd.DataFrame(out, columns=["obs_id", "company_id", "confidence"]).astype({"confidence": "float64"})

    return grouped.repartition("grp").sortWithinPartitions("grp", "obs_id").mapInPandas(run, "obs_id long, company_id long, confidence double")
