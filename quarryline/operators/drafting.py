"""Choices that depend on earlier ones, made in rounds: greedy selection under caps, and splits of groups with even labels."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .retrieval import top

#: Undecided rows of a group that a round looks at, at least; it looks at four times the group's cap if that is more.
VIEW = 1024
#: Groups that are dealt one by one: those with over 1/EXACT of all rows, or all if there are no more. Bins of the others.
EXACT, BINS, MOST_LABELS = 4096, 1024, 10_000


def greedy(rows: DataFrame, id_col: str, order: list[Column], caps: dict[str, int], conflicts: DataFrame) -> DataFrame:
    """id, accepted: what taking rows one after another gives, each unless a group that it is in has its cap of accepted rows
    (caps: by column; a null value is in no group) or a row that it conflicts with is accepted (a, b: ids, either way).

    A round decides every row about which the undecided rows before it can't matter: it is rejected if a cap is reached by
    accepted rows before it or one that it conflicts with is accepted; it is accepted if its groups have room even if all
    undecided rows before it in them were accepted, and none that it conflicts with is undecided. The first undecided row
    always is such a row, and in each group as many at once as there is room for. A group's accepted rows are at most its
    cap, and of its undecided rows the first VIEW or so meet in a task. order must tell all rows apart, ids too."""
    keys = {c: f"_g{i}" for i, c in enumerate(caps)}
    place = F.struct(*order, F.col(id_col))
    todo = written(rows.select(F.col(id_col).alias("_id"), place.alias("_at"), *[F.col(c).alias(k) for c, k in keys.items()]), "greedy")
    both = conflicts.select(F.col("a").alias("_id"), F.col("b").alias("_other")).unionByName(conflicts.select(F.col("b").alias("_id"), F.col("a").alias("_other"))).where("_id <> _other").distinct()
    other = todo.select(F.col("_id").alias("_other"), F.col("_at").alias("_before"))
    links = both.join(todo.select("_id", "_at"), "_id").join(other, "_other").where(F.col("_before") < F.col("_at"))
    links = written(links.select("_id", "_other"), "greedy-links")
    taken: list[DataFrame] = []
    gone: list[DataFrame] = []
    while not todo.isEmpty():
        now = todo
        state = {}
        for c, k in keys.items():
            view = top(todo.where(F.col(k).isNotNull()).select("_id", k, "_at"), [k], ["_at"], max(VIEW, 4 * caps[c]), "_n")
            state[c] = view.select("_id", F.col("_n").alias(f"_n{k}"))
        accepted = taken[0] if taken else None
        for t in taken[1:]:
            accepted = accepted.unionByName(t)
        sure, out = F.lit(True), F.lit(False)
        for c, k in keys.items():
            now = now.join(state[c], "_id", "left")
            if accepted is not None:
                full = accepted.where(F.col(k).isNotNull()).groupBy(k).agg(F.collect_list("_at").alias(f"_a{k}"))  # a cap's rows
                now = now.join(full, k, "left")
                before = F.coalesce(F.size(F.filter(f"_a{k}", lambda x: x < F.col("_at"))), F.lit(0))
                before = F.when(F.col(f"_a{k}").isNull(), 0).otherwise(before)
            else:
                before = F.lit(0)
            none = F.col(k).isNull()
            out = out | (~none & (before >= caps[c]))
            sure = sure & (none | F.coalesce(before + F.col(f"_n{k}") - 1 < caps[c], F.lit(False)))
        open_ = links.join(todo.select(F.col("_id").alias("_other")), "_other").groupBy("_id").agg(F.lit(True).alias("_open"))
        now = now.join(open_, "_id", "left")
        if accepted is not None:
            hit = links.join(accepted.select(F.col("_id").alias("_other")), "_other").groupBy("_id").agg(F.lit(True).alias("_hit"))
            now = now.join(hit, "_id", "left")
            out = out | F.coalesce("_hit", F.lit(False))
        verdict = F.when(out, False).when(sure & F.col("_open").isNull(), True)
        now = written(now.select("_id", "_at", *keys.values(), verdict.alias("_yes")), "greedy-round")
        taken.append(now.where("_yes").drop("_yes"))
        gone.append(now.where("not _yes").select("_id"))
        todo = now.where("_yes is null").drop("_yes")
    out = rows.sparkSession.createDataFrame([], f"{id_col} {dict(rows.dtypes)[id_col]}, accepted boolean")
    for yes, parts in ((True, taken), (False, gone)):
        for p in parts:
            out = out.unionByName(p.select(F.col("_id").alias(id_col), F.lit(yes).alias("accepted")))
    return out


def group_split(rows: DataFrame, group: str, fields: dict[str, float], ratios: dict[str, float], seed: str = "42", size_weight: float = 3.0) -> DataFrame:
    """group, split: each group in one split, sizes and labels near their ratios. fields: label columns and their weights; a
    null label is a label, and so is a null group a group.

    Groups with over 1/EXACT of all rows (all groups, if there are at most EXACT) are dealt one after another, large ones
    first, each to the split where the weighted squares of what sizes and labels differ from their share grow least. The
    others are small: by the label of the first field that most of their rows have and BINS bins of a hash, whole bins go
    to the split that lacks most of that label, so that a label's share differs by a bin and a group at most."""
    spark = rows.sparkSession
    named = {f: F.coalesce(F.col(f).cast("string"), F.lit("\0")) for f in fields}
    base = rows.select(F.col(group).alias("g"), *[c.alias(f"f{i}") for i, c in enumerate(named.values())])
    sizes = written(base.groupBy("g").agg(F.count("*").alias("n")), "groups")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"f{i}").alias("label")) for i in range(len(named))]))
    counts = written(base.select("g", each.alias("x")).groupBy("g", "x.f", "x.label").agg(F.count("*").alias("n")), "labels")
    total, groups = sizes.agg(F.sum("n"), F.count("*")).first()
    empty = f"{group} {dict(rows.dtypes)[group]}, split string"
    if not total:
        return spark.createDataFrame([], empty)
    whole = {(r.f, r.label): r.n for r in counts.groupBy("f", "label").agg(F.sum("n").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(whole) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("g").cast("string"), F.lit(""))), 256)
    sizes = sizes.withColumn("h", h).withColumn("large", F.lit(groups <= EXACT) | (F.col("n") * EXACT > total))
    large = sizes.where("large").orderBy(F.desc("n"), "h").collect()  # EXACT groups at most
    of = defaultdict(list)
    for r in counts.join(F.broadcast(sizes.where("large").select("g", "h")), counts["g"].eqNullSafe(sizes["g"])).select("h", "f", "label", counts["n"]).collect():
        of[r.h].append((r.f, r.label, r.n))
    weights, names = list(fields.values()), list(ratios)
    have, got = dict.fromkeys(names, 0), {s: defaultdict(int) for s in names}
    grows = lambda now, more, want: ((now + more - want) ** 2 - (now - want) ** 2) / max(1.0, want)
    dealt = []
    for r in large:
        cost = {s: size_weight * grows(have[s], r.n, total * ratios[s]) + sum(weights[f] * grows(got[s][f, x], n, whole[f, x] * ratios[s]) for f, x, n in of[r.h]) for s in names}
        best = min(names, key=lambda s: (round(cost[s], 9), names.index(s)))
        have[best] += r.n
        for f, x, n in of[r.h]:
            got[best][f, x] += n
        dealt.append((r.g, best))
    out = spark.createDataFrame(dealt, empty)
    small = sizes.where("not large")
    main = counts.where("f = 0").groupBy("g").agg(F.max_by("label", F.struct("n", "label")).alias("label"))
    binned = small.join(main, small["g"].eqNullSafe(main["g"])).select(small["g"], "n", "label", F.pmod(F.xxhash64("h"), F.lit(BINS)).alias("bin"))
    places = []
    lack = {(x, s): whole[0, x] * ratios[s] - got[s][0, x] for x in {x for f, x in whole if f == 0} for s in names}
    for r in binned.groupBy("label", "bin").agg(F.sum("n").alias("n")).orderBy("label", F.desc("n"), "bin").collect():  # labels x BINS
        best = max(names, key=lambda s: (lack[r.label, s], -names.index(s)))
        lack[r.label, best] -= r.n
        places.append((r.label, r.bin, best))
    where = spark.createDataFrame(places, "label string, bin long, split string")
    return out.unionByName(binned.join(F.broadcast(where), ["label", "bin"]).select(F.col("g").alias(group), "split"))


def split_report(rows: DataFrame, field: str, ratios: dict[str, float]) -> DataFrame:
    """split, label, n, share (of the label's rows) and gap (share - ratio), for rows with a column split."""
    c = rows.groupBy("split", F.col(field).alias("label")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("label"))  # a row for each split and label
    want = F.element_at(F.create_map(*[F.lit(x) for p in ratios.items() for x in p]), F.col("split"))
    return c.select("split", "label", "n", F.round(share, 6).alias("share"), F.round(share - want, 6).alias("gap"))
