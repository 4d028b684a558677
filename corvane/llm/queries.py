"""Queries over the operators of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import entity, formdup, mixing, neardup, packing, subjects, survivor, textform, tokens
from corvane.session import cut, small, table

MERGED_FIELDS = ["title", "year", "rating", "overview"]


# -- 2: plain form of titles ---------------------------------------------------------------------


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, row_key, title) of the three tables that hold titles."""
    parts = [("media_item", "parsed.raw_title"), ("tmdb_movie", "original_title"), ("mb_recording", "title")]
    return _union([table(spark, sf_dir, t).select(F.lit(t).alias("tab"), F.col("id").cast("string").alias("row_key"), F.col(c).alias("title")) for t, c in parts])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose title is not in plain form."""
    return textform.disguised(titles(spark, sf_dir), "title").select("tab", "row_key").distinct()


def p2_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title with its plain form and its key; titles that read alike have one key."""
    return textform.normalise(titles(spark, sf_dir), "title").distinct()


# -- 3: near-duplicate items ---------------------------------------------------------------------

NEAR = 0.7


def _item_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = neardup.words_of(F.col("parsed.raw_title"), F.col("parsed.release_group"), F.col("path"))
    return table(spark, sf_dir, "media_item").select("id", words.alias("words"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items whose word sets have a similarity of at least 0.7."""
    pairs = neardup.pairs_of(*neardup.similar_sets(_item_words(spark, sf_dir), "id", "words", NEAR))
    return pairs.select(F.col("a").alias("a_id"), F.col("b").alias("b_id"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the group of near-duplicates it belongs to and its number of links."""
    return neardup.groups_of(*neardup.similar_sets(_item_words(spark, sf_dir), "id", "words", NEAR))


# -- 4: duplicates hidden by formatting ----------------------------------------------------------


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are copies of an earlier one."""
    found = formdup.copies(table(spark, sf_dir, "raw_scan"), "line_id", "line")
    return found.select(F.col("first").alias("first_id"), F.col("copy").alias("copy_id"))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per distinct record, with its number of copies."""
    return formdup.collapse(table(spark, sf_dir, "raw_scan"), "line_id", "line").select(F.col("first").alias("first_id"), "copies")


# -- 5: items and films --------------------------------------------------------------------------

MATCH_EPSILON = 0.01


def _films(spark: SparkSession, sf_dir: str, operator: Callable[..., DataFrame]) -> DataFrame:
    items = table(spark, sf_dir, "media_item").filter("media_type = 'Movie'").select("id", F.col("parsed.raw_title").alias("title"), F.col("parsed.year").alias("year"))
    films = table(spark, sf_dir, "tmdb_movie").select("id", "title", "original_title", F.expr("try_cast(regexp_extract(release_date, '(?:^|[^0-9])((?:18|19|20)[0-9]{2})(?:[^0-9]|$)', 1) as int)").alias("year"))
    return operator(items, films, "id", "id", "year", "year", ["title"], ["title", "original_title"])


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _films(spark, sf_dir, entity.match)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Film items and the film they are a file of."""
    return _matches(spark, sf_dir).select(F.col("left_key").alias("item_id"), F.col("right_key").alias("tmdb_id"))


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Film items, their film and the confidence of the match."""
    return _matches(spark, sf_dir).select(F.col("left_key").alias("item_id"), F.col("right_key").alias("tmdb_id"), F.round("confidence", 6).alias("confidence"))


def p5_best_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item for each film and one film for each item, of all pairs that may match, so that the total confidence is the greatest.

    In parts too large for that, it is less by MATCH_EPSILON a pair at most.
    """
    edges = _films(spark, sf_dir, entity.candidates).select(F.col("left_key").alias("left"), F.col("right_key").alias("right"), "confidence")
    kept = entity.one_to_one(edges, epsilon=MATCH_EPSILON)
    return kept.select(F.col("left").alias("item_id"), F.col("right").alias("tmdb_id"), F.round("confidence", 6).alias("confidence"))


# -- 6: best representative ----------------------------------------------------------------------


def _duplicates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    groups = table(spark, sf_dir, "duplicate_group").select("content_id", survivor.strategy(F.col("keep_strategy")).alias("strategy"))
    files = table(spark, sf_dir, "media_item").select(F.col("id").alias("item_index"), "file_size", "mtime", *[F.col(f"scraped.{f}").alias(f) for f in MERGED_FIELDS])
    return survivor.valid_items(table(spark, sf_dir, "duplicate_item")), groups, files


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept item of each group and the items that give the values of its merged record."""
    return survivor.representatives(*_duplicates(spark, sf_dir), MERGED_FIELDS)


def p6_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged record: the value of each field and the item it is taken from."""
    return survivor.representatives(*_duplicates(spark, sf_dir), MERGED_FIELDS, values=True).filter("field <> 'record'")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sources say of each group's title, year and original title."""
    items = survivor.valid_items(table(spark, sf_dir, "duplicate_item")).select("content_id", "item_index")
    fields = ["title", "year", "title_original"]
    files = table(spark, sf_dir, "media_item").filter("scraped is not null").select(F.col("id").alias("item_index"), F.col("scraped.source").alias("source"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f"scraped.{f}").cast("string")).alias("value")) for f in fields])).alias("c"))
    return items.join(files.filter("c.value <> ''"), "item_index").select(F.col("content_id").alias("entity"), "c.field", "c.value", "source")


def p6_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of scraped title, year and original title judged true for each group, by the sources' inferred quality."""
    judged, _ = survivor.truth(_claims(spark, sf_dir))
    return judged.filter("probability > 0.5").select(F.col("entity").alias("content_id"), "field", "value", F.round("probability", 6).alias("probability"), "stated", "denied")


def p6_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inferred quality of each source."""
    _, quality = survivor.truth(_claims(spark, sf_dir))
    return quality.select("source", F.round("sensitivity", 6).alias("sensitivity"), F.round("specificity", 6).alias("specificity"))


def p6_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the value chosen by the fixed ladder is the one that the model finds likeliest, by field."""
    judged, _ = survivor.truth(_claims(spark, sf_dir))
    chosen = p6_merged(spark, sf_dir).filter("field in ('title', 'year')").withColumnRenamed("content_id", "entity")
    return survivor.agreement(chosen, judged.filter("field in ('title', 'year')"))


# -- 7: filling containers -----------------------------------------------------------------------


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, specs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_spec")
    names = [r[0] for r in specs.select("tokenizer").filter("tokenizer is not null").distinct().collect()]
    sized = cut(tokens.count_tokens(docs, "doc_id", "text", names))
    return packing.pack(sized, specs, packing.most_pieces(sized, specs)), specs


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or piece of one that is larger than a container, with its container, for each spec."""
    packed, _ = _packed(spark, sf_dir)
    return packed.select("spec_id", "bin_id", F.col("key").alias("doc_id"), "part", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each spec are."""
    return packing.fill_report(*_packed(spark, sf_dir)).withColumn("used", F.round("used", 6))


# -- 8: mixing sources ---------------------------------------------------------------------------

MIX_TOKENIZER = "gpt2"


def _mixed(spark: SparkSession, sf_dir: str, filled: bool = False) -> tuple[DataFrame, DataFrame]:
    sized, targets = tokens.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", [MIX_TOKENIZER], keep=["source"]), table(spark, sf_dir, "mix_target")
    if not filled:
        return mixing.mix(spark, sized, targets)
    sized = cut(sized)
    total = sized.filter("key is not null and tokens > 0").join(small(targets.select("source").distinct()), "source", "left_semi").agg(F.sum("tokens")).first()[0]
    return mixing.mix(spark, sized, targets, total=float(total or 0))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: documents of each source by the slot of their block and their place in the stream of the source."""
    return _mixed(spark, sf_dir)[0].withColumnRenamed("key", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all tokens that each source reaches in the mix, beside its target."""
    return _mixed(spark, sf_dir)[1].withColumn("reached_share", F.round("reached_share", 6))


def p8_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix with as many tokens as the sources hold, whose shares p8_filled_shares reports."""
    return _mixed(spark, sf_dir, filled=True)[0].withColumnRenamed("key", "doc_id")


def p8_filled_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of a mix of as many tokens as the sources hold: sources at their cap fall short, the others take over the rest."""
    return _mixed(spark, sf_dir, filled=True)[1].withColumn("reached_share", F.round("reached_share", 6))


# -- 9: subject areas ----------------------------------------------------------------------------


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects_of(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_label"), table(spark, sf_dir, "subject_area"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of every document."""
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p9_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The make-up of the corpus: documents of each subject, and how much of them is about it."""
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.avg("share"), 6).alias("mean_share"))


def p9_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects with a part of a document's mixture of 0.07 at least, by the factorisation alone."""
    found = subjects.mixtures_of(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_label"), table(spark, sf_dir, "subject_area"))
    return found.select("doc_id", "subject", F.round("weight", 3).alias("weight")).distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_titles, p3_found, p3_groups, p4_found, p4_records, p5_found, p5_matches, p5_best_files, p6_found, p6_merged, p6_truth, p6_sources, p6_agreement, p7_packed, p7_fill, p8_mix, p8_shares, p8_filled, p8_filled_shares, p9_found, p9_mixtures, p9_corpus)}

_LINES = r"""
with told as (
  select line_id, line, starts_with(trim(line), '{') and json_valid(line) is_json, contains(line, '|') piped from raw_scan
),
pairs as (
  select line_id, k name, json_extract_string(line::json, '$."' || k || '"') val from (select line_id, line, unnest(json_keys(line::json)) k from told where is_json)
  union all
  select line_id, case when p > 0 then part[:p - 1] else part end, case when p > 0 then part[p + 1:] else '' end
  from (select line_id, part, instr(part, case when piped then ':' else '=' end) p
        from (select line_id, piped, unnest(string_split(line, case when piped then '|' else ';' end)) part from told where not is_json))
),
leaves as (
  select distinct line_id, lower(regexp_replace(name, '[^\p{L}\p{N}]+', '', 'g')) n, lower(regexp_replace(coalesce(val, ''), '[^\p{L}\p{N}]+', '', 'g')) v
  from pairs where trim(name) <> '' or trim(val) <> ''
),
shape as (select line_id, string_agg(n || '=' || v, ';' order by n, v) s from leaves group by line_id),
grouped as (select line_id, min(line_id) over (partition by s) first_id, s from shape)
"""
_ITEMS = """
with item as (
  select distinct content_id, item_index, case when isnan(quality_score) then null else quality_score end q, case when isnan(metadata_confidence) then null else metadata_confidence end c, is_keep
  from duplicate_item qualify dense_rank() over (partition by content_id, item_index order by decided_at desc nulls last) = 1
),
grp as (select content_id, lower(regexp_replace(keep_strategy, '[^A-Za-z]', '', 'g')) s from duplicate_group),
file as (select distinct id, file_size, mtime, scraped.title title, scraped.year::varchar as "year", scraped.rating::varchar rating, scraped.overview overview from media_item),
j as (select i.*, g.s, f.* from item i left join grp g using (content_id) left join file f on f.id = i.item_index),
kept as (
  select content_id, 'record' field, item_index from j where s in ('highestquality', 'newest', 'largest')
  qualify row_number() over (partition by content_id order by case when s = 'highestquality' then q end desc nulls last, case when s = 'highestquality' then c end desc nulls last,
    case when s = 'newest' then mtime end desc nulls last, case when s <> 'newest' then file_size end desc nulls last, item_index desc) = 1
  union all select content_id, 'record', max(item_index) from j where s = 'manual' and is_keep group by content_id having count(*) = 1
),
vals as (unpivot (select content_id, item_index, c, mtime, title, "year", rating, overview from j) on title, "year", rating, overview into name field value value),
best as (select content_id, field, item_index, value from vals where trim(value) <> '' qualify row_number() over (partition by content_id, field order by c desc nulls last, mtime desc nulls last, item_index desc) = 1)
"""
_WORD_SETS = r"""
with recursive item as (select distinct id, list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', parsed.raw_title, parsed.release_group, path)), '[\p{L}\p{N}]+'))) w from media_item where id is not null),
word as (select id, len(w) n, unnest(w) x from item),
pair as (select a.id a_id, b.id b_id, count(*) c from word a join word b on a.x = b.x and a.id < b.id group by 1, 2 having count(*) / (any_value(a.n) + any_value(b.n) - count(*))::double >= 0.7::double),
class as (select id, min(id) over (partition by w) class_id from item where len(w) > 0),
link as (select distinct a.class_id a, b.class_id b from pair join class a on a.id = a_id join class b on b.id = b_id where a.class_id <> b.class_id),
both_ways as (select a, b from link union select b, a from link),
reach as (select class_id a, class_id b from class union select r.a, l.b from reach r join both_ways l on l.a = r.b)
"""


def _model(rounds: int = 8) -> str:
    """The rounds of expectation-maximisation, one after the other."""
    out = """
with valid as (select distinct content_id, item_index from duplicate_item where content_id is not null and item_index is not null),
said as (select distinct id, scraped.source s, unnest(['title', 'year', 'title_original']) field, trim(unnest([scraped.title, scraped."year"::varchar, scraped.title_original])) v from media_item where scraped is not null),
told as (select distinct content_id e, field, v, s from valid join said on id = item_index where v <> '' and s is not null),
seen as materialized (select v.e, v.field, v.v, sp.s, t.s is not null states from (select distinct e, field, v from told) v join (select distinct e, field, s from told) sp on sp.e = v.e and sp.field = v.field left join told t on t.e = v.e and t.field = v.field and t.v = v.v and t.s = sp.s),
q0 as (select distinct s, 0.8::double sens, 0.9::double spec from seen)"""
    for i in range(rounds + 1):
        out += f""",
j{i} as materialized (select e, field, v, 1 / (1 + exp(-(sum(ln(case when states then sens else 1 - sens end) - ln(case when states then 1 - spec else spec end)) + ln(0.4::double / 0.6::double)))) p, sum(states::int) stated, sum((not states)::int) denied from seen join q{i} using (s) group by e, field, v)"""
        if i < rounds:
            out += f""",
q{i + 1} as materialized (select s, (sum(p * states::int) + 8) / (sum(p) + 10) sens, (sum((1 - p) * (1 - states::int)) + 9) / (sum(1 - p) + 10) spec from seen join j{i} using (e, field, v) group by s)"""
    return out


ORACLE = {
    "p6_truth": _model() + " select e content_id, field, v as value, round(p, 6) probability, stated::bigint stated, denied::bigint denied from j8 where p > 0.5",
    "p6_sources": _model() + " select s source, round(sens, 6) sensitivity, round(spec, 6) specificity from q8",
    "p6_agreement": _model()
    + ", "
    + _ITEMS.strip().removeprefix("with ")
    + """,
chosen as (select content_id e, field, trim(value) v from best where field in ('title', 'year')), likely as (select e, field, max(p) top from j8 where field in ('title', 'year') group by e, field),
held as (select c.e, c.field, c.v, j8.p from chosen c left join j8 on j8.e = c.e and j8.field = c.field and j8.v = c.v),
both_sides as (select coalesce(h.field, l.field) field, h.v, l.top, coalesce(h.p >= l.top - 1e-9, false) same from held h full join likely l on h.e = l.e and h.field = l.field)
select field, count(*) groups, count_if(same) same, count_if(v is not null and top is not null and not same) other, count_if(v is not null and top is null) only_chosen, count_if(v is null and top is not null) only_judged from both_sides group by field""",
    "p3_found": _WORD_SETS + "select a_id, b_id from pair",
    "p3_groups": _WORD_SETS + "select id, (select min(b) from reach where a = class_id) group_id, (select count(*) from both_ways l where l.a = class_id) n_links from class",
    "p4_found": _LINES + "select first_id, line_id copy_id from grouped where line_id > first_id",
    "p4_records": _LINES + "select first_id, count(*) copies from grouped group by first_id",
    "p6_found": _ITEMS + "select content_id, field, item_index from kept union all select content_id, field, item_index from best",
    "p6_merged": _ITEMS + "select content_id, field, item_index, value from best",
}
