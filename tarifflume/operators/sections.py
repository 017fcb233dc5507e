"""Vendors, layout blocks, sections and chunks of document text."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarifflume.functions.labels import ocr_header, section_header
from tarifflume.operators.positions import number_within, running
from tarifflume.session import written_folder

# Weighted wording of the four section types, in tie order.
SECTION_WORDING: dict[str, list[tuple[str, float]]] = {
    "pricing": [
        (r"(?i)\brate\s*(table|schedule|card)?\b", 1.5),
        (r"(?i)\bzone\s*\d*\b", 1.2),
        (r"(?i)\bdiscount\b", 1.0),
        (r"(?i)\bbase\s*rate\b", 1.5),
        (r"(?i)\bnet\s*(charge|rate)\b", 1.0),
        (r"(?i)\bminimum\s*charge\b", 1.0),
        (r"(?i)\bweight\s*(tier|break|range|limit)\b", 1.2),
        (r"(?i)\bper\s+pound\b", 1.0),
        (r"(?i)\bdim(ensional)?\s*(weight|divisor|factor)\b", 1.2),
        (r"(?i)\bground\b", 0.5),
        (r"(?i)\bovernight\b", 0.5),
        (r"(?i)\b2[\s-]?day\b", 0.5),
        (r"(?i)\bpriority\s*overnight\b", 0.8),
        (r"(?i)\bexpress\b", 0.5),
        (r"(?i)\bpublished\s*(rate|tariff)\b", 1.0),
        (r"\$\s*\d+\.\d{2}\b", 0.8),
        (r"(?i)\b\d+\s*%\s*(discount|off)\b", 1.2),
    ],
    "surcharge": [
        (r"(?i)\bsurcharge\b", 2.0),
        (r"(?i)\baccessorial\b", 2.0),
        (r"(?i)\bfuel\s*(surcharge|adjustment|index)?\b", 1.5),
        (r"(?i)\bresidential\s*(delivery|surcharge|fee)?\b", 1.5),
        (r"(?i)\bdelivery\s*area\s*(surcharge|DAS)?\b", 1.5),
        (r"(?i)\b(extended|remote)\s*delivery\s*area\b", 1.5),
        (r"(?i)\badditional\s*handling\b", 1.2),
        (r"(?i)\boversize\b", 1.0),
        (r"(?i)\bsignature\s*(required|service)\b", 1.0),
        (r"(?i)\baddress\s*correction\b", 1.0),
        (r"(?i)\bsaturday\s*(delivery|pickup)\b", 1.0),
        (r"(?i)\bpeak\s*(surcharge|season)?\b", 0.8),
        (r"\bDAS\b", 1.5),
        (r"\bFSC\b", 1.5),
        (r"\bAHS\b", 1.2),
        (r"(?i)\bwaived?\b", 0.8),
        (r"(?i)\bflat\s*(fee|rate|amount)\b", 0.8),
    ],
    "terms": [
        (r"(?i)\bterm(s)?\s+(and\s+condition|of\s+agreement|of\s+service)\b", 2.0),
        (r"(?i)\bgoverning\s+law\b", 2.0),
        (r"(?i)\bindemnif(y|ication)\b", 2.0),
        (r"(?i)\bliabilit(y|ies)\b", 1.2),
        (r"(?i)\btermination\b", 1.0),
        (r"(?i)\bconfidential(ity)?\b", 1.2),
        (r"(?i)\barbitration\b", 1.5),
        (r"(?i)\bforce\s+majeure\b", 1.5),
        (r"(?i)\bwarrant(y|ies|ed)?\b", 0.8),
        (r"(?i)\bintellectual\s+property\b", 1.0),
        (r"(?i)\bnotice\s+period\b", 0.8),
        (r"(?i)\bauto[\s-]?renew\b", 0.8),
    ],
    "boilerplate": [
        (r"(?i)\bdefinitions?\b", 1.5),
        (r"(?i)\brecitals?\b", 1.5),
        (r"(?i)\bwhereas\b", 2.0),
        (r"(?i)\bin\s+witness\s+whereof\b", 2.0),
        (r"(?i)\bpreamble\b", 1.5),
        (r"(?i)\bhereinafter\b", 1.5),
        (r"(?i)\bherein\b", 0.5),
        (r"(?i)\bexhibit\s+[a-z]\b", 0.8),
        (r"(?i)\bappendix\b", 0.8),
        (r"(?i)\bschedule\s+\d+\b", 0.6),
        (r"(?i)\bnotice\s+to\s+proceed\b", 0.8),
    ],
}
SCORE = "decimal(8,2)"


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def detect_vendor(documents: DataFrame) -> DataFrame:
    """Best of four additive keyword scores (the earlier vendor wins ties) with its signals."""
    t = F.col("t")
    # Vendor -> (shown name, [(test, weight, signal)])
    scorers = {
        "fedex": ("FedEx", [
            (_any(t, ["fedex", "federal express"]), "0.6", "keyword:fedex"),
            (t.rlike(r"\bfedex\s+(express|ground|freight)\b"), "0.25", "keyword:fedex_service"),
            (_any(t, ["service guide"]) & _any(t, ["fedex"]), "0.15", "keyword:service_guide"),
        ]),
        "ups": ("UPS", [
            (_any(t, ["ups", "united parcel service"]), "0.6", "keyword:ups"),
            (t.rlike(r"\bups\s+(ground|air|freight)\b"), "0.25", "keyword:ups_service"),
            (_any(t, ["tariff"]) & _any(t, ["ups"]), "0.15", "keyword:tariff"),
        ]),
        "3pl": (None, [
            (_any(t, ["warehouse", "pick and pack", "pick/pack", "kitting", "storage fee", "pallet in", "pallet out", "fulfillment", "receiving", "handling fee"]), "0.65", "keyword:3pl_ops"),
            (_any(t, ["sla", "service level agreement", "order cutoff", "same day shipping"]), "0.2", "keyword:sla"),
            (_any(t, ["monthly minimum", "minimum monthly"]), "0.1", "keyword:monthly_minimum"),
        ]),
        "freight": (None, [
            (_any(t, ["ltl", "less-than-truckload", "nmfc", "class 50", "class 55", "class 60", "class 65", "class 70", "class 77.5", "class 85", "class 92.5", "class 100"]), "0.55", "keyword:ltl_nmfc_class"),
            (t.rlike(r"\b(fuel\s+surcharge|accessorial|rebill|reweigh|reclass)\b"), "0.25", "keyword:freight_accessorial"),
            (_any(t, ["bill of lading", "bol"]), "0.1", "keyword:bol"),
        ]),
    }
    options = []
    for i, (vendor, (name, tests)) in enumerate(scorers.items()):
        score = reduce(add, [F.when(hit, F.lit(w).cast(SCORE)).otherwise(F.lit(0).cast(SCORE)) for hit, w, _ in tests])
        signals = F.array_compact(F.array(*[F.when(hit, F.lit(s)) for hit, _, s in tests]))
        options.append(
            F.struct(
                F.least(score.cast(SCORE), F.lit(1).cast(SCORE)).alias("confidence"), F.lit(-i).alias("earlier"), F.lit(vendor).alias("vendor_type"),
                F.lit(name).cast("string").alias("vendor_name"), signals.alias("signals"),
            )
        )
    best = documents.select("doc_id", F.lower("text").alias("t")).select("doc_id", F.array_max(F.array(*options)).alias("b"))
    known = F.col("b.confidence") > 0
    return best.select(
        "doc_id", F.when(known, F.col("b.vendor_type")).otherwise("unknown").alias("vendor_type"), F.when(known, F.col("b.vendor_name")).alias("vendor_name"),
        F.col("b.confidence").alias("confidence"), F.col("b.signals").alias("signals"),
    )


def layout_blocks(pages: DataFrame) -> DataFrame:
    """Header and paragraph blocks of page text, in page order.

    A page is one row of text, so windows and lists stay inside one page.
    """
    lines = pages.select("doc_id", "page_number", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line_no", "raw")).select(
        "doc_id", "page_number", "line_no", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("text")
    )
    gap = (F.col("text") == "") | F.col("text").rlike(r"^[-=]{4,}$")
    tagged = lines.withColumn("gap", gap).withColumn("is_header", ~F.col("gap") & ocr_header(F.col("text")))
    along = Window.partitionBy("doc_id", "page_number").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    cut = (F.col("gap") | F.col("is_header")).cast("int")
    island = tagged.withColumn("island", F.sum(cut).over(along)).where("not gap")
    return island.groupBy("doc_id", "page_number", "island", "is_header").agg(
        F.min("line_no").alias("block_no"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text"),
    ).select("doc_id", "page_number", "block_no", F.when(F.col("is_header"), "header").otherwise("paragraph").alias("block_type"), "text")


def table_blocks(tables: DataFrame, first_block: int = 100_000) -> DataFrame:
    """Page tables as blocks of cell text, after the text blocks of their page."""
    rows = F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "  "))
    return tables.select(
        "doc_id", "page_number", (F.lit(first_block) + F.col("table_ord")).cast("int").alias("block_no"), F.lit("table").alias("block_type"), F.array_join(rows, "\n").alias("text")
    )


def downgrade_repeats(blocks: DataFrame) -> DataFrame:
    """Headers that appeared earlier in the document become paragraphs.

    The first place of each header text is a map-side aggregate joined back.
    """
    place = F.struct("page_number", "block_no")
    key = F.trim("text")
    first = (
        blocks.where("block_type = 'header'").groupBy("doc_id", key.alias("header_text")).agg(F.min(place).alias("first_place"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    joined = blocks.withColumn("header_text", F.when(F.col("block_type") == "header", key)).join(first, ["doc_id", "header_text"], "left")
    again = F.col("first_place").isNotNull() & (place > F.col("first_place"))
    return joined.select("doc_id", "page_number", "block_no", F.when(again, "paragraph").otherwise(F.col("block_type")).alias("block_type"), "text")


def sections(blocks: DataFrame, pages_per_block: int = 256) -> DataFrame:
    """Sections opened by headers: title, page span and content text.

    The span ends on the page of the next header, so a header is also sent to the section
    before it.
    """
    numbered = running(
        blocks, ["doc_id"], ["page_number", "block_no"], F.coalesce(F.floor(F.col("page_number") / pages_per_block), F.lit(-1)),
        sums={"section_no": (F.col("block_type") == "header").cast("bigint")},
    )
    role = lambda name, n: F.struct(F.lit(name).alias("role"), n.alias("section_no"))
    n = F.col("section_no")
    roles = F.when(F.col("block_type") == "header", F.array(role("title", n), role("next", n - 1))).otherwise(F.array(role("body", n)))
    sent = numbered.withColumn("sent", F.explode(roles)).drop("section_no").select("*", "sent.role", "sent.section_no")
    own = F.col("role") != "next"
    body = F.collect_list(F.when(F.col("role") == "body", F.struct("page_number", "block_no", "text")))
    grouped = sent.groupBy("doc_id", "section_no").agg(
        F.count_if(own).alias("own_blocks"),
        F.max(F.when(F.col("role") == "title", F.col("text"))).alias("title"),
        F.min(F.when(own, F.col("page_number"))).alias("page_start"),
        F.max("page_number").alias("page_end"),
        F.array_join(F.transform(F.array_sort(body), lambda b: b["text"]), "\n").alias("content"),
    )
    return grouped.where("own_blocks > 0").drop("own_blocks")


def _opening(pattern: str) -> str:
    """Lower-case letters that every match of a pattern begins with; '' where they are not plain."""
    found = re.match(r"(?:\(\?i\))?\\b([A-Za-z0-9]+)([?*{|]?)", pattern)
    if not found or found[2] == "|":
        return ""
    return (found[1][:-1] if found[2] else found[1]).lower()


def _score(text: str, wording: list[tuple[str, float]]) -> Column:
    """Points of a text column for the patterns in it; `_low_<text>` spares the search for those that cannot begin."""
    zero = F.lit(0).cast(SCORE)
    hit = lambda p: F.contains(F.col(f"_low_{text}"), F.lit(_opening(p))) & F.col(text).rlike(p) if _opening(p) else F.col(text).rlike(p)
    return reduce(add, [F.when(hit(p), F.lit(str(w)).cast(SCORE)).otherwise(zero) for p, w in wording]).cast(SCORE)


def classify_sections(found: DataFrame) -> DataFrame:
    """Section type by weighted wording, titles counting twice; under 2 points is unknown.

    The best type leaves an `explode` of one element: a filter on it is not carried below, where
    Spark would search all patterns again.
    """
    texts = {"_title": F.coalesce("title", F.lit("")), "_content": F.col("content")}
    read = found.withColumns(texts).withColumns({f"_low_{name}": F.lower(name) for name in texts})
    options = []
    for i, (kind, wording) in enumerate(SECTION_WORDING.items()):
        both = _score("_content", wording) + 2 * _score("_title", wording)
        options.append(F.struct(both.cast(SCORE).alias("score"), F.lit(-i).alias("earlier"), F.lit(kind).alias("kind")))
    best = F.col("_best")
    strong = best["score"] >= 2
    conf = F.round(F.least((best["score"] * F.lit("0.1").cast("decimal(2,1)")).cast("decimal(8,3)"), F.lit(1).cast("decimal(8,3)")), 3)
    return read.select(*found.columns, F.explode(F.array(F.array_max(F.array(*options)))).alias("_best")).select(
        *found.columns, F.when(strong, best["kind"]).otherwise("unknown").alias("section_type"), F.when(strong, conf).otherwise(F.lit(0)).cast("decimal(8,3)").alias("confidence")
    )


def sections_of_type(classified: DataFrame, *kinds: str) -> DataFrame:
    return classified.where(F.col("section_type").isin(*kinds))


def _kept(df: DataFrame, folder: str) -> DataFrame:
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def greedy_starts(items: DataFrame, keys: list[str], target: int, per_block: int = 4096) -> DataFrame:
    """(keys, no) of the items at which a run begins when items are merged in order as long as
    a run's `size` stays below `target`; an item that is larger stands alone.

    `items` holds keys, `no` (from 0, gapless) and `size` (above 0). Each item's successor is the
    item that covers the character `target` behind its own begin, found in bins of `target`
    characters, so no window is larger than a bin. From item 0 the runs are reached by pointer
    doubling: each round squares the jumps, so there are as many rounds as the longest chain
    has binary digits. The rounds are written to the shared folder, two at a time.
    """
    spark = items.sparkSession
    folder = written_folder(spark, "runs")
    upto = running(items.select(*keys, "no", "size"), keys, ["no"], F.floor(F.col("no") / per_block), sums={"upto": F.col("size")})
    upto = upto.withColumn("begin", F.col("upto") - F.col("size"))
    bin_of = lambda c: F.floor(c / target).cast("bigint")
    place = lambda at, seeker: F.struct(at.cast("bigint").alias("at"), F.col("no").cast("bigint").alias("no"), F.lit(seeker).alias("seeker"))
    seek = F.col("begin") + target
    covers = upto.select(*keys, F.explode(F.sequence(bin_of(F.col("begin") + 1), bin_of(F.col("upto")))).alias("bin"), place(F.col("upto"), False).alias("p"))
    events = covers.unionByName(upto.select(*keys, bin_of(seek).alias("bin"), place(seek, True).alias("p"))).select(*keys, "bin", "p.*")
    back = Window.partitionBy(*keys, "bin").orderBy(F.desc("at"), "seeker").rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("to", F.last(F.when(~F.col("seeker"), F.col("no")), ignorenulls=True).over(back)).where("seeker and to is not null")
    jumps = _kept(found.select(*keys, "no", F.greatest("to", F.col("no") + 1).alias("to")), f"{folder}/jumps-0")
    starts = items.where("no = 0").select(*keys, F.col("no").cast("bigint").alias("no"))
    turn = 0
    while not jumps.isEmpty():
        turn += 1
        reached = starts.join(jumps, [*keys, "no"]).select(*keys, F.col("to").alias("no"))
        starts = _kept(starts.unionByName(reached), f"{folder}/starts-{turn % 2}")
        further = jumps.select(*keys, F.col("no").alias("to"), F.col("to").alias("beyond"))
        jumps = _kept(jumps.join(further, [*keys, "to"]).select(*keys, "no", F.col("beyond").alias("to")), f"{folder}/jumps-{turn % 2}")
    return starts.join(items.select(*keys, "no"), [*keys, "no"], "left_semi")


def _runs(items: DataFrame, keys: list[str], target: int, name: str, per_block: int = 4096) -> DataFrame:
    """`items` (keys, no, size) with the number, from 0, of the run that each belongs to."""
    starts = greedy_starts(items, keys, target, per_block).withColumn("_start", F.lit(1).cast("bigint"))
    flagged = items.select(*keys, "no").join(starts, [*keys, "no"], "left")
    numbered = running(flagged, keys, ["no"], F.floor(F.col("no") / per_block), sums={name: F.coalesce("_start", F.lit(0))})
    return numbered.select(*keys, "no", (F.col(name) - 1).cast("int").alias(name))


def _joined(order: list[str], text: str, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), between)


def chunks(pages: DataFrame, target: int = 6000, limit: int = 10000, pages_per_block: int = 4096) -> DataFrame:
    """Chunks of documents: page groups opened by a section header, merged greedily below
    `target` characters, and split on blank lines above `limit`.

    Both greedy steps are runs of `greedy_starts`, over page groups and over the paragraphs of
    chunks above `limit`. Such a chunk's text is never one string: its paragraphs stay rows until
    the part they belong to is known. Paragraphs are cut page by page; a last line feed without a
    partner goes to the next page, so the cuts are those of the whole text. Null texts are empty;
    an empty table gives no rows. The rounds run while the result is built.
    What several steps read (places of pages, facts of chunks, paragraphs of long chunks) is written
    to the shared folder.
    """
    key = ["doc_id", "chunk"]
    folder = written_folder(pages.sparkSession, "chunks")
    body = F.concat(F.lit("\n\n--- Page "), F.col("page_number").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    firsts = pages.groupBy("doc_id").agg(F.min("page_number").alias("first_page"))
    tables = F.col("has_tables") if "has_tables" in pages.columns else F.lit(False)
    tail = F.length(F.regexp_extract(body, r"\s*\z", 0))
    opened = pages.select(
        "doc_id", "page_number", F.length(body).alias("chars"), tail.alias("tail"), section_header(F.coalesce(F.col("text"), F.lit(""))).alias("header"), tables.alias("has_tables")
    ).join(firsts, "doc_id")
    opens = (F.col("header").isNotNull() & (F.col("page_number") > F.col("first_page"))).cast("bigint")
    grouped = running(opened, ["doc_id"], ["page_number"], F.floor(F.col("page_number") / pages_per_block), sums={"no": opens})
    grouped = _kept(grouped.drop("first_page"), f"{folder}/pages")
    sizes = _kept(grouped.groupBy("doc_id", "no").agg(F.sum("chars").alias("size")), f"{folder}/groups")
    placed = _kept(grouped.join(_runs(sizes, ["doc_id"], target, "chunk"), ["doc_id", "no"]), f"{folder}/placed")

    titled = F.when(F.col("header").isNotNull(), F.struct("no", "page_number"))
    facts = placed.groupBy(*key).agg(
        F.array_sort(F.collect_list("page_number")).alias("pages"),
        F.min_by(F.struct("no", "header"), titled).alias("title"), F.min("no").alias("first_no"), F.bool_or("has_tables").alias("has_tables"),
        (F.sum("chars") - 2 - F.max_by("tail", "page_number")).alias("size"),  # the text begins with two line feeds
    ).select(
        *key, "pages", F.when(F.col("title.no") == F.col("first_no"), F.col("title.header")).alias("section_header"), "has_tables",
        (F.col("size") > limit).alias("long"), F.element_at("pages", 1).alias("first_page"), F.element_at("pages", -1).alias("last_page"),
    )
    facts = _kept(facts, f"{folder}/facts")
    first, last = F.col("page_number") == F.col("first_page"), F.col("page_number") == F.col("last_page")
    head = F.when(first, F.regexp_replace("body", r"^\s+", "")).otherwise(F.col("body"))
    places = placed.select(*key, "page_number").join(facts.select(*key, "long", "first_page", "last_page"), key)
    cut = pages.select("doc_id", "page_number", body.alias("body")).join(places, ["doc_id", "page_number"]).withColumn("body", head)
    cut = cut.withColumn("body", F.when(last, F.regexp_replace("body", r"\s+\z", "")).otherwise(F.col("body")))
    whole = cut.where("not long").groupBy(*key).agg(_joined(["page_number"], "body", "").alias("text")).select(*key, F.lit(0).alias("part"), "text")

    odd = F.length(F.regexp_extract("body", r"\n*\z", 0)) % 2 == 1
    moved = running(cut.where("long").withColumn("odd", odd), key, ["page_number"], F.floor(F.col("page_number") / pages_per_block), befores={"carry": F.col("odd")})
    even = F.when(F.col("odd"), F.expr("left(body, length(body) - 1)")).otherwise(F.col("body"))
    texts = F.split(F.concat(F.when(F.coalesce("carry", F.lit(False)), "\n").otherwise(""), even), "\n\n")
    own = F.when(first, texts).otherwise(F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0))))  # the blank line before a page is no paragraph
    paragraphs = moved.select(*key, "page_number", F.posexplode(own).alias("place", "text"))
    paragraphs = number_within(paragraphs, key, ["page_number", "place"], F.floor(F.col("page_number") / 64)).withColumn("no", F.col("number") - 1)
    paragraphs = _kept(paragraphs.select(*key, "no", "text"), f"{folder}/paragraphs")
    spans = paragraphs.select(*key, "no", (F.length("text") + 2).cast("bigint").alias("size"))  # with the blank line before it
    runs = _runs(spans, key, target + 3, "run")
    parts = paragraphs.join(runs, [*key, "no"]).groupBy(*key, "run").agg(_joined(["no"], "text", "\n\n").alias("text")).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    filled = running(parts.where("text <> ''"), key, ["run"], F.floor(F.col("run") / 4096), sums={"part": F.lit(1).cast("bigint")})
    split = filled.select(*key, (F.col("part") - 1).cast("int").alias("part"), "text")
    about = facts.select(*key, "pages", "section_header", "has_tables")
    return whole.unionByName(split).join(about, key).select("doc_id", "chunk", "part", "text", "pages", "section_header", "has_tables")
