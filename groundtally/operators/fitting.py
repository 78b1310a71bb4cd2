"""Exhaustive fitting of measurement conventions: every grid cell scored over every item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundtally.functions import dims, geometry, questions
from groundtally.functions import fixed_values as V
from groundtally.operators import answers, regions, scoring, taxonomy
from groundtally.session import cut_lineage

MMU_GRID = (0, 1, 2, 4, 8, 16, 32)
RADII = (0, 1, 2, 3, 5)
DIAGONALS = ("NE", "SE", "SW", "NW")


def each(values, name: str) -> Column:
    return F.explode(dims.literal_array(values)).alias(name)


def chosen_option(ann: DataFrame, task: str) -> DataFrame:
    """(id, patch_id, class_name, text of the released option) of one MCQ task."""
    p = answers._tasks(answers.parsed_questions(ann), task)
    text = F.get(F.filter("options", lambda o: o["letter"] == F.col("output")), F.lit(0))["text"]
    return p.select("id", "patch_id", F.get("classes", F.lit(0)).alias("class_name"), text.alias("text")).filter(
        "class_name is not null and text is not null")


def count_items(ann: DataFrame) -> DataFrame:
    truth = F.replace(F.regexp_extract("text", V.TASK_INTEGER, 1), F.lit(","), F.lit("")).try_cast("long")
    return chosen_option(ann, "mcq|count").select("id", "patch_id", "class_name", truth.alias("truth")).filter("truth is not null")


def area_items(ann: DataFrame) -> DataFrame:
    return chosen_option(ann, "mcq|area").withColumn("r", answers.option_range(F.col("text"))).filter("r.lo is not null and r.hi is not null").select(
        "id", "patch_id", "class_name", "r.lo", "r.hi")


def _best_first(grid: DataFrame, *order) -> DataFrame:
    """Ranks the cells of a parameter grid (a few dozen rows)."""
    return grid.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def sweep_count(items: DataFrame, px: DataFrame, level: str = "c19") -> DataFrame:
    """Connectivity x minimum mapping unit: accuracy per cell, ranked by (accuracy, smaller unit)."""
    areas = None
    own = regions.level_runs(px, level)
    filled = cut_lineage(regions.fill_holes(own.runs, max_side=own.side))  # the same for both connectivities
    for conn in (4, 8):
        reg = regions.region_properties(regions.components(filled, conn, max_side=own.side))
        one = reg.select("patch_id", "cls", "area_px").withColumn("connectivity", F.lit(conn))
        areas = one if areas is None else areas.unionByName(one)
    counts = areas.select("connectivity", "patch_id", "cls", "area_px", each(MMU_GRID, "mmu")).filter("area_px >= mmu").groupBy(
        "connectivity", "mmu", "patch_id", "cls").agg(F.count("*").alias("found"))
    named = counts.join(F.broadcast(dims.c19_dim(px.sparkSession)), "cls").drop("cls")
    cells = items.withColumn("connectivity", F.explode(dims.literal_array((4, 8)))).withColumn("mmu", F.explode(dims.literal_array(MMU_GRID)))
    hit = cells.join(named, ["connectivity", "mmu", "patch_id", "class_name"], "left").withColumn("hit", F.coalesce("found", F.lit(0)) == F.col("truth"))
    grid = scoring.per_group_accuracy(hit, "class_name", "connectivity", "mmu")
    return _best_first(grid, F.round("per_group_acc", 9).desc(), "mmu", "connectivity")


def sweep_interval_rule(items: DataFrame, facts: DataFrame) -> DataFrame:
    """(named facts) accuracy of each boundary rule on released area ranges."""
    d = items.join(facts.select("patch_id", "class_name", "coverage_pct"), ["patch_id", "class_name"], "left").withColumn(
        "coverage_pct", F.coalesce("coverage_pct", F.lit(0.0)))
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), geometry.in_interval(r, F.col("coverage_pct"), F.col("lo"), F.col("hi")).alias("hit")) for r in V.INTERVAL_RULES])
    return scoring.per_group_accuracy(d.select("class_name", F.explode(rows).alias("x")).select("class_name", "x.*"), "class_name", "rule")


def sweep_dilation(ann: DataFrame, px: DataFrame, radii: tuple[int, ...] = RADII) -> DataFrame:
    """Accuracy of released yes/no adjacency answers at every dilation radius."""
    d = answers._tasks(answers.parsed_questions(ann), "binary|adjacency").filter(F.size("classes") == 2)
    d = d.select("id", "patch_id", F.get("classes", F.lit(0)).alias("name_a"), F.get("classes", F.lit(1)).alias("name_b"), "output")
    touch = answers.named_pairs(regions.contact_radius(px, radii)).select("patch_id", "name_a", "name_b", "radius")
    d = d.join(touch, ["patch_id", "name_a", "name_b"], "left").withColumn("k", F.explode(dims.literal_array(radii)))
    adjacent = F.coalesce(F.col("radius") <= F.col("k"), F.lit(False))
    hit = d.select("k", F.concat_ws("|", "name_a", "name_b").alias("pair"), (adjacent == (F.col("output") == "yes")).alias("hit"))
    return scoring.per_group_accuracy(hit, "pair", "k")


# ------------------------------------------------------------------------------ direction convention
def direction_items(ann: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per usable relative-position item: options with a compass, truth, and points under every rule.

    Usable means both classes present and the released option parses as a direction.
    """
    p = answers._tasks(answers.parsed_questions(ann), "mcq|relative pos").filter(F.size("classes") >= 2)
    opts = F.filter(F.transform("options", lambda o: F.struct(o["letter"].alias("letter"), questions.option_direction(o["text"]).alias("way"))),
                    lambda o: o["way"].isNotNull())
    a, b = F.get("classes", F.lit(0)), F.get("classes", F.lit(1))
    d = p.select("id", "patch_id", (F.col("patch_id") % 5).alias("fold"), questions.template_family(F.col("input")).alias("family"),
                 questions.subject_is_second(F.col("input")).alias("shipped_flip"), a.alias("name_a"), b.alias("name_b"),
                 F.col("output").alias("truth"), opts.alias("opts"))
    d = d.filter(F.exists("opts", lambda o: o["letter"] == F.col("truth")))
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(c[0]).alias("p_row"), F.col(c[1]).alias("p_col")) for r, c in
                     (("mask_centroid", ("mask_row", "mask_col")), ("largest_component", ("big_row", "big_col")), ("bbox_centre", ("box_row", "box_col")))])
    pts = facts.select("patch_id", "class_name", rows.alias("pts"))
    return d.join(pts.select("patch_id", F.col("class_name").alias("name_a"), F.col("pts").alias("pa")), ["patch_id", "name_a"]).join(
        pts.select("patch_id", F.col("class_name").alias("name_b"), F.col("pts").alias("pb")), ["patch_id", "name_b"]).withColumn(
        "pair", F.concat_ws("|", "name_a", "name_b"))


def with_rules(items: DataFrame) -> DataFrame:
    """One row per item and reference rule, with the offset of the first class from the second."""
    return items.select("*", F.explode(F.arrays_zip("pa", "pb")).alias("z")).select(
        *[c for c in items.columns if c not in ("pa", "pb")], F.col("z.pa.rule").alias("rule"),
        (F.col("z.pa.p_row") - F.col("z.pb.p_row")).alias("d_row"), (F.col("z.pa.p_col") - F.col("z.pb.p_col")).alias("d_col"))


def predicted_direction(flip: Column, band: Column) -> Column:
    s = F.when(flip, F.lit(-1.0)).otherwise(F.lit(1.0))
    return geometry.compass(geometry.bearing(s * F.col("d_row"), s * F.col("d_col")), band)


def pick_option(direction: Column) -> Column:
    """struct<gap, letter> of the nearest option; null when the direction is undefined."""
    return F.when(direction.isNotNull(), F.array_min(F.transform(
        "opts", lambda o: F.struct(geometry.angular_gap(direction, o["way"]).alias("gap"), o["letter"].alias("letter")))))


def predicted(df: DataFrame, flip: Column, band: Column, prefix: str = "") -> DataFrame:
    """Adds {prefix}dir, {prefix}letter, {prefix}exact."""
    d = df.withColumn(prefix + "dir", predicted_direction(flip, band))
    d = d.withColumn("_p", pick_option(F.col(prefix + "dir")))
    return d.withColumns({prefix + "letter": F.col("_p.letter"), prefix + "exact": F.coalesce(F.col("_p.gap") == 0, F.lit(False))}).drop("_p")


def orientation_fit(items: DataFrame, rule: str = "mask_centroid", band: float = 45.0) -> DataFrame:
    """Per template family: accuracy as written and flipped, the fitted flip, agreement with the shipped rule."""
    d = with_rules(items).filter(F.col("rule") == rule)
    d = predicted(predicted(d, F.lit(False), F.lit(band), "w_"), F.lit(True), F.lit(band), "f_")
    hits = d.select("family", "pair", "shipped_flip", F.coalesce(F.col("w_letter") == F.col("truth"), F.lit(False)).alias("w"),
                    F.coalesce(F.col("f_letter") == F.col("truth"), F.lit(False)).alias("f"))
    per = hits.groupBy("family", "pair").agg(F.count("*").alias("m"), F.count_if("w").alias("w"), F.count_if("f").alias("f"), F.count_if("shipped_flip").alias("s"))
    out = per.groupBy("family").agg(F.sum("m").alias("n"), F.round(F.avg(F.col("w") / F.col("m")), 9).alias("as_written"),
                                    F.round(F.avg(F.col("f") / F.col("m")), 9).alias("flipped"), F.sum("s").alias("shipped"))
    return out.withColumn("flip", F.col("flipped") > F.col("as_written")).withColumn(
        "agree", F.when(F.col("flip"), F.col("shipped")).otherwise(F.col("n") - F.col("shipped"))).drop("shipped")


def direction_grid(items: DataFrame, bands) -> DataFrame:
    """Reference rule x band under the shipped orientation, with peak and plateau (within 0.5 points) per rule."""
    d = with_rules(items).withColumn("band", F.explode(dims.literal_array([float(b) for b in bands])))
    d = predicted(d, F.col("shipped_flip"), F.col("band"))
    hit = d.select("rule", "band", "pair", "exact", F.coalesce(F.col("letter") == F.col("truth"), F.lit(False)).alias("hit"))
    per = hit.groupBy("rule", "band", "pair").agg(F.count("*").alias("m"), F.count_if("hit").alias("h"), F.count_if("exact").alias("e"))
    g = per.groupBy("rule", "band").agg(F.round(F.avg(F.col("h") / F.col("m")), 9).alias("per_pair_acc"), (F.sum("h") / F.sum("m")).alias("pooled_acc"),
                                        (F.sum("e") / F.sum("m")).alias("exact_rate"), F.sum("m").alias("n"))
    top = F.max("per_pair_acc").over(Window.partitionBy("rule"))  # one row per band
    return g.withColumn("peak", F.col("per_pair_acc") == top).withColumn("plateau", F.col("per_pair_acc") >= top - 0.005)


def diagonal_match(items: DataFrame, bands, rule: str = "mask_centroid") -> DataFrame:
    """Predicted share of diagonal directions per band against the released share; rank 1 matches best."""
    d = with_rules(items).filter(F.col("rule") == rule)
    d = d.withColumn("obs", F.exists("opts", lambda o: (o["letter"] == F.col("truth")) & o["way"].isin(*DIAGONALS)))
    d = d.withColumn("band", F.explode(dims.literal_array([float(b) for b in bands])))
    d = d.withColumn("dir", predicted_direction(F.col("shipped_flip"), F.col("band")))
    g = d.groupBy("band").agg((F.count_if(F.col("dir").isin(*DIAGONALS)) / F.count("*")).alias("predicted_rate"), (F.count_if("obs") / F.count("*")).alias("observed_rate"))
    g = g.withColumn("error", F.abs(F.col("predicted_rate") - F.col("observed_rate")))
    return _best_first(g, "error", "band")


def rule_decidability(items: DataFrame, band: float = V.DIAGONAL_BAND_DEG) -> DataFrame:
    """For each pair of reference rules: items whose point differs, and items whose answer differs."""
    d = predicted(with_rules(items), F.col("shipped_flip"), F.lit(band))
    told = d.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rule", "d_row", "d_col", "letter"))).alias("own"))  # three rules per item
    pairs = F.flatten(F.transform("own", lambda a: F.transform(F.filter("own", lambda b: b["rule"] > a["rule"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return told.select(F.inline(pairs)).groupBy(F.col("a.rule").alias("rule_a"), F.col("b.rule").alias("rule_b")).agg(
        F.count("*").alias("n"), F.count_if((F.round("a.d_row", 6) != F.round("b.d_row", 6)) | (F.round("a.d_col", 6) != F.round("b.d_col", 6))).alias("point_differs"),
        F.count_if(~F.col("a.letter").eqNullSafe(F.col("b.letter"))).alias("answer_differs"))


def residual_errors(items: DataFrame, group: str, rule: str = "mask_centroid", band: float = V.DIAGONAL_BAND_DEG) -> DataFrame:
    """Errors and their share by group, before (no flips, 45 degrees) and after the fitted convention."""
    d = with_rules(items).filter(F.col("rule") == rule)
    d = predicted(predicted(d, F.lit(False), F.lit(45.0), "b_"), F.col("shipped_flip"), F.lit(band), "a_")
    g = d.groupBy(group).agg(F.count("*").alias("n"), F.count_if(~F.col("b_letter").eqNullSafe(F.col("truth"))).alias("errors_before"),
                             F.count_if(~F.col("a_letter").eqNullSafe(F.col("truth"))).alias("errors"))
    total = F.sum("errors").over(Window.partitionBy())  # one row per group
    return g.withColumns({"accuracy": 1 - F.col("errors") / F.col("n"), "share_of_errors": scoring.ratio(F.col("errors"), total),
                          "delta": (F.col("errors_before") - F.col("errors")) / F.col("n")})
