"""Parts lists: matching with the catalog and with own parts, prices, and what of them is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderline.functions.expressions import norm_token
from tenderline.operators.matching import pieces_of
from tenderline.params import DEFAULT, Params
from tenderline.sources.scratch import written

# fixed values: confidence of a price by where it comes from
CONFIDENCE = {"exact": 0.95, "normalized": 0.85, "internal": 0.85, "internal_other": 0.6, "internal_unpriced": 0.5, "new": 0.2}
STOCK_CONFIDENCE, NO_STOCK_CONFIDENCE = 0.9, 0.2
#: Characters of a catalog token by which texts are looked up.
GRAM = 3
#: What is written of an item.
KIND = ["part_number", "description", "standard"]


def item_text() -> Column:
    """What is written of an item, normalised: number, description and standard."""
    return norm_token(F.concat_ws(" ", *KIND))


def _found(kinds: DataFrame, catalog: DataFrame) -> DataFrame:
    """Different KIND rows with catalog_number, catalog_price and how.

    Of catalog rows with the same tokens only the first can be found by them, so texts meet lists of tokens, each once, and not rows. The lists are written: while they are few, Spark broadcasts them by
    the size of their files, and the pieces of the texts need no shuffle.
    """
    c = catalog.select("ord", F.col("part_number").alias("catalog_number"), F.col("unit_price").alias("catalog_price"), norm_token(F.col("part_number")).alias("n"), F.transform(F.split("tokens", r"\|"), norm_token).alias("tokens"))
    row = F.struct("catalog_number", "catalog_price")
    keyed = kinds.withColumns({"_n": norm_token(F.col("part_number")), "_t": item_text()})
    exact = c.where("n <> ''").groupBy(F.col("n").alias("_n")).agg(F.min_by(row, "ord").alias("exact"))
    keyed = keyed.join(exact, "_n", "left")
    texts = keyed.where("exact is null").select("_t").distinct()
    told = c.where("tokens is not null").groupBy(F.array_sort(F.array_distinct("tokens")).alias("tokens")).agg(F.min_by(row, "ord").alias("row"), F.min("ord").alias("ord"))
    rarity = told.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("f"))
    usual = told.select("ord", F.explode("tokens").alias("token")).where(F.length("token") >= GRAM).join(rarity, "token")
    keys = usual.groupBy("ord").agg(F.min_by("token", F.struct("f", -F.length("token"), "token")).alias("key"))
    lists = written(told.join(keys, "ord", "left").select("ord", "row", "tokens", F.substring("key", 1, GRAM).alias("piece")), "lists")
    inside = F.forall("tokens", lambda x: F.contains(F.col("_t"), x))
    by_key = pieces_of(texts, "_t", GRAM).join(lists, "piece").where(inside)
    short = texts.join(lists.where("piece is null"), inside)
    loose = by_key.select("_t", "ord", "row").unionByName(short.select("_t", "ord", "row")).groupBy("_t").agg(F.min_by("row", "ord").alias("loose"))
    out = keyed.join(loose, "_t", "left").withColumn("how", F.when(F.col("exact").isNotNull(), "exact").when(F.col("loose").isNotNull(), "normalized"))
    hit = F.coalesce("exact", "loose")
    return out.select(*KIND, hit["catalog_number"].alias("catalog_number"), hit["catalog_price"].alias("catalog_price"), "how")


def _with_kinds(items: DataFrame, kinds: DataFrame) -> DataFrame:
    """items with what is known of their kinds: the one join in which all items move."""
    k = kinds.withColumnsRenamed({c: f"_{c}" for c in KIND})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KIND]
    return items.join(k, same, "left").drop(*[f"_{c}" for c in KIND])


def match_catalog(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """NR-03: items (part_number, description, standard, ...) with catalog_number, catalog_price and how (exact, normalized; null: no match).

    An equal normalised number wins; else the first catalog row (by ord) all of whose tokens (cut by |) stand in the item's text.
    Items that are written the same are matched once. A list of tokens is looked up by the first GRAM characters of the token that fewest lists have, which must be a piece of
    the text; lists of shorter tokens only meet all texts.
    """
    return _with_kinds(items, _found(items.select(*KIND).distinct(), catalog))


def internal_costs(part_costs: DataFrame, qty: int, params: Params = DEFAULT) -> DataFrame:
    """BM-03: per part the recorded cost at the home plant at the nearest quantity, else at any other plant; ties to the lower cost."""
    away = F.col("plant") != params.home_plant
    best = F.min_by(F.struct(F.col("unit_cost"), away.alias("away"), "plant"), F.struct(away.cast("int"), F.abs(F.col("qty") - qty), F.col("unit_cost"), F.col("plant")))
    return part_costs.groupBy("part_id").agg(best.alias("b")).select("part_id", "b.*")


def price_bom(bom: DataFrame, catalog: DataFrame, numbers: DataFrame, costs: DataFrame) -> DataFrame:
    """BM-02, BM-03: items with source, method, matched, unit_cost, plant and confidence.

    Exact catalog number, else own part number, else catalog text, else new and unpriced. numbers: part_id, part_number of own
    parts; costs: of internal_costs(). Numbers and costs grow with the parts, so they are merged and never broadcast.
    """
    own = numbers.join(costs.hint("merge"), "part_id", "left").select(F.col("part_number").alias("own_number"), F.col("unit_cost").alias("own_cost"), "away", "plant")
    x = _found(bom.select(*KIND).distinct(), catalog).join(own.hint("merge"), F.col("part_number") == F.col("own_number"), "left")
    bought = (F.col("how") == "exact") | (F.col("how").isNotNull() & F.col("own_number").isNull())
    made = F.col("own_number").isNotNull()
    method = F.when(bought, F.col("how")).when(made, F.when(F.col("own_cost").isNull(), "internal_unpriced").when(F.col("away"), "internal_other").otherwise("internal")).otherwise("new")
    source = F.when(bought, "catalog").when(made, "internal").otherwise("new")
    sure = F.element_at(F.create_map(*[F.lit(v) for kv in CONFIDENCE.items() for v in kv]), method)
    kinds = x.select(*KIND, source.alias("source"), method.alias("method"), F.when(bought, F.col("catalog_number")).when(made, F.col("own_number")).alias("matched"), F.when(bought, F.col("catalog_price")).when(made, F.col("own_cost")).alias("unit_cost"), F.when(~F.coalesce(bought, F.lit(False)) & made, F.col("plant")).alias("plant"), sure.alias("confidence"))
    return _with_kinds(bom.select("part_id", "item_no", "qty", *KIND), kinds)


def unpriced(priced: DataFrame) -> DataFrame:
    """BM-04: per part the items without a price, in their order."""
    label = F.trim(F.concat_ws(" ", "part_number", "description"))
    open_ = priced.where("unit_cost is null").groupBy("part_id").agg(F.array_sort(F.collect_list(F.struct("item_no", label.alias("label")))).alias("x"))
    return open_.select("part_id", F.size("x").alias("n_unpriced"), F.array_join(F.transform("x", lambda i: i["label"]), "; ").alias("items"))


def priced_share(priced: DataFrame) -> DataFrame:
    """TR-05: per part the share of its items that have a price."""
    return priced.groupBy("part_id").agg((F.count("unit_cost") / F.count("*")).alias("bom_match"))


def new_items(priced: DataFrame) -> DataFrame:
    """VA-07: items that no catalog row, no own part and no standard explains."""
    return priced.where("source = 'new' and coalesce(standard, '') = ''").select("part_id", "item_no", F.coalesce("part_number", "description").alias("label"))


def single_part_bom(measured: DataFrame, ops: DataFrame, materials: DataFrame) -> DataFrame:
    """BM-01: of made parts the raw material (weight of the stock), then each outsourced service once, in the order of operations.

    Without a known material weight and price are open. measured: of geometry.measure(); ops: of routing.rule_routing(). Materials are a small table.
    """
    m = materials.select(F.col("code").alias("material_code"), "density", "price_eur_kg")
    made = measured.where("shape_class <> 'assembly'").join(m, "material_code", "left")
    kilos = lambda v: F.round(F.coalesce(F.col(v) * F.col("density") / 1000, F.lit(0.0)) + 1e-7, 3)
    known = F.col("density").isNotNull()
    stock = made.select("part_id", F.lit(1).alias("item_no"), F.when(known, F.col("material_code")).alias("number"), F.lit("raw_material").alias("source"), kilos("stock_cm3").alias("qty"), F.col("price_eur_kg").alias("unit_cost"), F.when(known, STOCK_CONFIDENCE).otherwise(NO_STOCK_CONFIDENCE).alias("confidence"))
    first = ops.where("service_code is not null").groupBy("part_id", "service_code").agg(F.min_by(F.struct("seq", "confidence"), "seq").alias("o"))
    nth = F.row_number().over(Window.partitionBy("part_id").orderBy("o.seq"))
    services = first.withColumn("item_no", nth + 1).join(made.select("part_id", kilos("finished_cm3").alias("qty")), "part_id")
    services = services.select("part_id", "item_no", F.col("service_code").alias("number"), F.lit("service").alias("source"), "qty", F.lit(None).cast("double").alias("unit_cost"), F.col("o.confidence").alias("confidence"))
    return stock.unionByName(services)
