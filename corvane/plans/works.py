"""Queries over works, their plans and duplicates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import evidence, identify, paths, scoring, titles
from corvane.operators import dedup, folders, identity, linking, planning
from corvane.plans import library
from corvane.plans.library import _CLEAN, _ITEM, _RENAMES, _TRUST, items, named_items
from corvane.session import cut, table
from corvane.sources import files

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_DIR = "regexp_replace({0}, '/?[^/]*$', '')"
_STEM = r"regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '(.)\.[^.]*$', '\1')"
_EXT = r"regexp_extract({0}, '[^/]\.([^./]*)$', 1)"
_SAFE = r"""trim(regexp_replace(translate({0}, '<>:"/\|?*', '_________'), '\s+', ' ', 'g'))"""


def _digits(x: str) -> str:
    return f"lpad({x}::varchar, greatest(2, length({x}::varchar))::int, '0')"


# -- folders and subtitles -----------------------------------------------------------------------

_FOLDERS = (
    rf"""
, fn as (select id, path, media_type, nullif({_SAFE.format("title")}, '') t, y, sn, {_DIR.format("path")} own from pref where path is not null),
fm as (select *, {_DIR.format("own")} above from fn),
fe as (select distinct array_to_string(string_split(own, '/')[:len(string_split(own, '/')) - k], '/') dir from (select distinct own from fm), unnest(range(30)) u(k) where len(string_split(own, '/')) - k >= 1),
seasons as (select distinct {_DIR.format("dir")} dir from fe where regexp_full_match(trim(regexp_extract(dir, '([^/]*)$', 1)), '(?i)(?:S\d{{1,2}}|Season\s+\d{{1,2}})')),
fw as (select id, 0 k, own old_path, 'Season ' || {_digits("sn")} nm from fm where media_type in ('TvShow', 'Strm') and sn is not null
  union all select id, 1, above, t from fm where media_type in ('TvShow', 'Strm') and t is not null
  union all select id, 2, own, t || coalesce(' (' || y || ')', '') from fm where media_type = 'Movie' and t is not null and above not in (select dir from seasons)),
fp as (select old_path, {_DIR.format("old_path")} || '/' || nm new_path from fw where regexp_extract(old_path, '([^/]*)$', 1) not in ('', nm) qualify row_number() over (partition by old_path order by id, k) = 1)
"""
)


def _folder_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.folder_plans(named_items(spark, sf_dir).select("id", "path", "media_type", "title", "year", "season").filter("path is not null"))


def _rename_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The renames, checkpointed as they are joined with what goes with them."""
    return cut(planning.rename_plan(named_items(spark, sf_dir)))


def _subtitle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subtitles that stored plans name."""
    return table(spark, sf_dir, "media_item").select(F.explode("rename_plan.subtitle_plans").alias("p")).select(F.col("p.old_path").alias("path")).filter("path is not null").distinct()


@query(_ITEM + _TRUST + _FOLDERS + "select * from fp")
def folder_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders whose name isn't that of the work or season they hold."""
    return _folder_plans(spark, sf_dir)


@query(
    _ITEM
    + _TRUST
    + _RENAMES
    + _FOLDERS
    + f""", ups as (select p.id, p.old_path, fp.old_path folder, fp.new_path new_folder from p join fp on starts_with(p.old_path, fp.old_path || '/'))
select id, old_path plan_path, (row_number() over (partition by id, old_path order by len(string_split(folder, '/')) desc) - 1)::int pos, folder, new_folder from ups
union all select null, old_path, 0, old_path, new_path from fp where old_path not in (select folder from ups)"""
)
def attached_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder renames that go with each file's, the deepest first; and those that go with none."""
    every = folders.attached(_rename_plans(spark, sf_dir).filter("old_path is not null"), _folder_plans(spark, sf_dir))
    return every.select("id", F.col("old_path").alias("plan_path"), F.posexplode("folder_plans").alias("pos", "f")).select("id", "plan_path", "pos", F.col("f.old_path").alias("folder"), F.col("f.new_path").alias("new_folder"))


_SUBTITLES = rf"""
, subs as (select distinct s.old_path sub from (select unnest(rename_plan.subtitle_plans) s from item) where s.old_path is not null),
subt as (select sub, {_DIR.format("sub")} dir, {_STEM.format("sub")} stem, lower({_EXT.format("sub")}) ext from subs),
sp as (select p.id, subt.sub old_path, case when {_EXT.format("p.old_path")} <> '' then p.new_path[:length(p.new_path) - length({_EXT.format("p.old_path")}) - 1] else p.new_path end || sub[length(dir) + 2 + length({_STEM.format("p.old_path")}):] new_path
  from p join subt on dir = {_DIR.format("p.old_path")} and {_STEM.format("p.old_path")} <> '' and (stem = {_STEM.format("p.old_path")} or starts_with(stem, {_STEM.format("p.old_path")} || '.') or starts_with(stem, {_STEM.format("p.old_path")} || '-')) where ext in ('srt', 'ass', 'ssa', 'sub', 'idx', 'vtt'))
"""


@query(_ITEM + _TRUST + _RENAMES + _SUBTITLES + "select * from sp")
def subtitle_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitles that are renamed with their file."""
    return folders.subtitle_plans(_rename_plans(spark, sf_dir), _subtitle_files(spark, sf_dir))


@query(
    _ITEM
    + _TRUST
    + _RENAMES
    + _SUBTITLES
    + """, mv as (select id, new_path, 'target' what from p union all select id, new_path, 'subtitle' from sp),
there as (select path from item where path is not null union select sub from subs except select old_path from p),
judged as (select id, what, count(*) over (partition by new_path) n, new_path in (from there) held from mv),
said as (select distinct id, c from (select id, unnest([case when n > 1 then what || '_wanted' end, case when held then what || '_exists' end]) c from judged) where c is not null)
select distinct p.id, coalesce(c, '') conflicts from p left join (select id, string_agg(c, ',' order by c) c from said group by id) s on s.id = p.id"""
)
def rename_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands against each rename."""
    plans, subs = _rename_plans(spark, sf_dir), _subtitle_files(spark, sf_dir)
    listing = items(spark, sf_dir, "path").filter("path is not null").unionByName(subs)
    found = folders.rename_conflicts(plans, folders.subtitle_plans(plans, subs), listing)
    return found.select("id", F.array_join("conflicts", ",").alias("conflicts"))


@query(
    _ITEM
    + rf""", subs as (select distinct s.old_path sub from (select unnest(rename_plan.subtitle_plans) s from item) where s.old_path is not null),
st as (select sub, {_DIR.format("sub")} dir, {_STEM.format("sub")} stem from subs where lower({_EXT.format("sub")}) in ('srt', 'ass', 'ssa', 'vtt')),
it as (select distinct id, {_DIR.format("path")} dir, {_STEM.format("path")} stem from item where path is not null),
named as (select it.id, sub from it join st on it.dir = st.dir and it.stem <> '' and (st.stem = it.stem or starts_with(st.stem, it.stem || '.') or starts_with(st.stem, it.stem || '-'))),
alone as (select dir, min(sub) sub from st group by dir having count(*) = 1)
select distinct id, sub subtitle from named union select it.id, alone.sub from it join alone using (dir) where it.id not in (select id from named)"""
)
def external_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subtitles beside each item: those named like it, or the only one of the folder."""
    return folders.external_subtitles(items(spark, sf_dir, "id", "path").filter("path is not null"), _subtitle_files(spark, sf_dir))


_LISTED = (
    rf""", near as (select distinct id, path, {_DIR.format("path")} dir from item where path is not null),
listed as (select {_DIR.format("path")} || '/' || {_STEM.format("path")} || '.nfo' p from item where path is not null and scraped.source = 'LocalNfo' and media_type = 'Movie'
  union select {_DIR.format(_DIR.format("path"))} || '/tvshow.nfo' from item where path is not null and scraped.source = 'LocalNfo' and media_type = 'TvShow')
"""
)


@query(
    _ITEM
    + _LISTED
    + rf""", tried as (select id, 0 level, dir || '/' || {_STEM.format("path")} || '.nfo' p from near union all
  select id, k + 1, array_to_string(string_split(dir, '/')[:len(string_split(dir, '/')) - k], '/') || '/tvshow.nfo' from near, unnest([0, 1, 2]) u(k) where len(string_split(dir, '/')) - k >= 1)
select id, p sidecar, level::int as level from tried where p in (from listed) qualify row_number() over (partition by id order by level) = 1"""
)
def sidecar_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata file of each item, from those that looked-up items were read from."""
    rows, path = table(spark, sf_dir, "media_item"), F.col("path")
    local = rows.filter("scraped.source = 'LocalNfo' and path is not null")
    listed = local.filter("media_type = 'Movie'").select(F.concat(paths.parent(path), F.lit("/"), paths.stem(path), F.lit(".nfo")).alias("path")).unionByName(local.filter("media_type = 'TvShow'").select(F.concat(paths.parent(paths.parent(path)), F.lit("/tvshow.nfo")).alias("path")))
    return folders.sidecars(items(spark, sf_dir, "id", "path").filter("path is not null"), listed)


_FIRST_TAG = "list_filter(list_transform(regexp_extract_all(text, '(?s)<{0}(?:[ \\t\\n\\r][^>]*)?>(.*?)</{0}>', 1), lambda v: regexp_replace(v, '^\\s+|\\s+$', '', 'g')), lambda v: v <> '')[1]"


@query(
    f"""with t as (select doc_id, text, {_FIRST_TAG.format("title")} title, {_FIRST_TAG.format("showtitle")} show_title, contains(text, '<episodedetails') epi from documents)
select doc_id, case when epi then coalesce(show_title, title) else title end title, case when epi then coalesce({_FIRST_TAG.format("episodename")}, title) end episode_name, {_FIRST_TAG.format("originaltitle")} title_original, try_cast({_FIRST_TAG.format("year")} as int) "year",
  {_FIRST_TAG.format("plot")} overview, try_cast({_FIRST_TAG.format("rating")} as double) rating, {_FIRST_TAG.format("thumb")} poster_url, {_FIRST_TAG.format("artist")} artist, try_cast({_FIRST_TAG.format("season")} as int) season_number from t where case when epi then coalesce(show_title, title) else title end is not null"""
)
def sidecar_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the metadata files among the documents say."""
    rows = table(spark, sf_dir, "documents").select("doc_id", files.sidecar_record(F.col("text")).alias("s")).filter("s is not null")
    return rows.select("doc_id", *[f"s.{c}" for c in ("title", "episode_name", "title_original", "year", "overview", "rating", "poster_url", "artist", "season_number")])


# -- sorting into a library ----------------------------------------------------------------------

_TIDY = r"""trim(translate({0}, '<>:"/\|?*', '_________'))"""
_LOCAL = rf"""
, ln as (select id, path old_path, {_DIR.format("path")} || '/' || {_TIDY.format("title")} || case when media_type = 'TvShow' and sn is not null then '/Season ' || {_digits("sn")} else '' end || '/' || regexp_extract(path, '([^/]*)$', 1) new_path from pref where title is not null and path is not null)
"""


@query(_ITEM + _TRUST + _LOCAL + "select id, old_path, new_path, 'HardLink' action from ln where new_path <> old_path")
def organize_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items linked into a folder of their title beside them."""
    return planning.organize_plan(named_items(spark, sf_dir), "/library", link="hard", mode="local")


@query(
    _ITEM
    + _TRUST
    + library._ORGANIZED
    + f""", mv as (select * from og where new_path <> old_path), nfo as (select distinct id from item where scraped is not null),
there as (select path from item where path is not null union select rename_plan.new_path from item where rename_plan.new_path is not null union select '/library/Movies/' || {_TIDY.format("title")} || '/' || {_STEM.format("path")} || '.nfo' from pref where media_type = 'Movie' and s.source = 'LocalNfo' and title is not null and path is not null),
said as (select id, 'target_wanted' c from mv where new_path in (select new_path from mv group by 1 having count(*) > 1) union select id, 'target_exists' from mv where new_path in (from there)
  union select id, 'sidecar_exists' from mv where id in (from nfo) and regexp_replace(new_path, '([^/])\\.[^./]*$', '\\1') || '.nfo' in (from there))
select distinct mv.id, coalesce(c, '') conflicts from mv left join (select id, string_agg(c, ',' order by c) c from said group by id) x on x.id = mv.id"""
)
def organize_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands against each move into the library."""
    named, raw = named_items(spark, sf_dir, F.col("scraped.source").alias("source")), table(spark, sf_dir, "media_item")
    old = named.filter("media_type = 'Movie' and source = 'LocalNfo' and title is not null and path is not null").select(F.concat_ws("/", F.lit("/library/Movies"), F.trim(F.translate("title", '<>:"/\\|?*', "_________")), F.concat(paths.stem(F.col("path")), F.lit(".nfo"))).alias("path"))
    listing = raw.select("path").unionByName(raw.select(F.col("rename_plan.new_path").alias("path"))).unionByName(old).filter("path is not null")
    plans = planning.organize_plan(named, "/library")
    return planning.organize_conflicts(plans, listing, raw.filter("scraped is not null").select("id")).select("id", F.array_join("conflicts", ",").alias("conflicts"))


_CUSTOM = {"Movie": "{{ title }}{% if year %} [{{ year }}]{% else %} [undated]{% endif %}{{ ext }}", "TvShow": "{title} {season}x{episode}"}


@query(
    _ITEM
    + _TRUST
    + rf""", n as (select id, path, {_EXT.format("path")} ext, {_DIR.format("path")} dir, {_digits("(case when sn is not null then greatest(sn - 1, 0) end)")} s2, {_digits("ep")} e2, title, y, media_type, coalesce(p.media_suffix, '') sfx from pref where media_type not in ('Strm', 'Music', 'Novel') or media_type is null),
m as (select *, case when media_type = 'TvShow' then coalesce(title, '') || ' ' || coalesce(s2, '') || 'x' || coalesce(e2, '') else coalesce(title, '') || case when y is not null then ' [' || y || ']' else ' [undated]' end end
  || case when sfx <> '' then ' - ' || sfx else '' end || case when media_type <> 'TvShow' and ext <> '' then '.' || ext else '' end raw from n),
c as (select *, """
    + _CLEAN.format(_CLEAN.format(_CLEAN.format(r"regexp_replace(regexp_replace(regexp_replace(raw, '\(\s*\)', '', 'g'), '\[\s*\]', '', 'g'), '  +', ' ', 'g')")))
    + r""" x from m),
d as (select id, path old_path, dir || '/' || nullif(regexp_replace(regexp_replace(trim(replace(regexp_replace(x, '(^|[^A-Za-z0-9])S(E\d{2}\b)', '\1\2', 'g'), '..', '.')), '[\s.]+$', ''), '^[\s.]+', ''), '') || case when ext <> '' and media_type = 'TvShow' then '.' || ext else '' end new_path from c)
select * from d where new_path is not null and new_path <> old_path"""
)
def custom_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New names of films and episodes by own templates, with media suffixes and seasons counted from 0."""
    rows = named_items(spark, sf_dir).filter("media_type not in ('Strm', 'Music', 'Novel') or media_type is null")
    return planning.rename_plan(rows, _CUSTOM, keep_suffix=True, season_offset=-1)


# -- lookups -------------------------------------------------------------------------------------


def _lookup_sql(asked: str, catalogue: str) -> str:
    """asked: (id, y, sh, seen, bare, kind); catalogue: (id, title, original_title, cy, vote_average)."""
    bare = library._bare_sql
    return f""", q as ({asked}), m as ({catalogue}),
f as (select id, y, sh, kind, lower(bare) own, [lower(bare), lower(array_to_string(list_filter(string_split(bare, ' '), lambda x: not regexp_matches(x, '^(19|20)[0-9]{{2}}$') and not regexp_matches(lower(x), '^s[0-9]{{2}}e[0-9]{{2}}$')), ' '))] forms,
  list_filter(list_transform(coalesce(seen, []), lambda x: lower({bare("x").replace("lambda x:", "lambda v:").replace("x <> ''", "v <> ''").replace("lower(x) not", "lower(v) not")})), lambda x: x <> '') shown from q),
c as (select id cid, cy, vote_average, lower({bare("title")}) theirs, coalesce(lower({bare("original_title")}), '') orig from m),
met as (select distinct f.id, c.cid from (select id, y, unnest(list_distinct(forms)) form from f) f join (select cid, cy, unnest(list_distinct([theirs, orig])) form from c) c on f.form = c.form and f.form <> '' and (f.y is null or c.cy is null or abs(f.y - c.cy) <= 1)),
j as (select f.*, c.*, list_position(list_transform(shown, lambda s: s = theirs or s = orig), true) hit from met join f using (id) join c using (cid)),
g as (select id, cid, (case when own <> '' and (theirs = own or orig = own) then 1.2::double when own <> '' and (contains(theirs, own) or contains(own, theirs) or (orig <> '' and contains(orig, own))) then 0.7::double else 0 end
  + case when y is null or cy is null then 0 when y = cy then 0.45::double when abs(y - cy) = 1 then 0.12::double else -0.25::double end + case when kind = 'TvShow' and sh is not null then 0.08::double else 0 end
  + 0.18::double * len(list_filter(case when hit > 0 then shown[:hit - 1] else shown end, lambda s: contains(theirs, s) or contains(s, theirs) or (orig <> '' and contains(orig, s)))) + case when hit > 0 then 0.48::double else 0 end
  + case when vote_average >= 7 then 0.05::double else 0 end)::float score from j),
r as (select *, row_number() over (partition by id order by score desc, cid) rank from g)
"""


_SERIES_SQL = _lookup_sql(
    f"select id, parsed.year y, coalesce(parsed.season, content_evidence.season_hypotheses[1]) sh, content_evidence.title_candidates seen, {library._bare_sql('trim(parsed.raw_title)')} bare, media_type kind from item where media_type = 'TvShow' and trim(parsed.raw_title) <> ''",
    'select scraped.tmdb_id id, min(scraped.title) title, min(scraped.title_original) original_title, min(scraped."year") cy, max(scraped.rating) vote_average from item where media_type = \'TvShow\' and scraped.tmdb_id is not null group by 1',
)
_FILM_SQL = _lookup_sql(
    f"select id, parsed.year y, null::int sh, content_evidence.title_candidates seen, {library._bare_sql('trim(parsed.raw_title)')} bare, media_type kind from item where media_type = 'Movie' and trim(parsed.raw_title) <> ''",
    "select distinct id, title, original_title, try_cast(release_date[:4] as int) cy, vote_average from tmdb_movie",
)


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "media_item").filter("media_type = 'TvShow' and scraped.tmdb_id is not null")
    series = known.groupBy(F.col("scraped.tmdb_id").alias("id")).agg(F.min("scraped.title").alias("title"), F.min("scraped.title_original").alias("original"), F.min("scraped.year").alias("year"), F.max("scraped.rating").alias("rating"))
    p, c = F.col("parsed"), F.col("content_evidence")
    asked = items(spark, sf_dir, "id", p["raw_title"].alias("title"), p["year"].alias("year"), identity.hint(p["season"], c["season_hypotheses"]).alias("season"), "media_type", c["title_candidates"].alias("seen"), identity.hint(p["episode"], c["episode_hypotheses"]).alias("episode")).filter("media_type = 'TvShow'")
    return linking.lookups(asked, series)


@query(_ITEM + _SERIES_SQL + "select id, cid series_id, round(score::double, 5) score, rank from r where rank <= 5")
def series_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five series for each episode by the forms of its title."""
    return _series(spark, sf_dir).select("id", F.col("c_id").alias("series_id"), F.round(F.col("score").cast("double"), 5).alias("score"), "rank")


@query(
    _ITEM
    + _SERIES_SQL
    + """, counted as (select id, cid, score, count(*) over (partition by id) n, rank from r where rank <= 5), best as (select id, cid, case when n = 1 then 0.9::float else greatest(0.9::float, least(greatest((0.62::float + (score * 0.18::float)::float)::float, 0.62::float), 0.97::float)) end conf from (select *, row_number() over (partition by id order by score desc, rank desc) k from counted) where k = 1),
h as (select id, coalesce(parsed.season, content_evidence.season_hypotheses[1]) season, coalesce(parsed.episode, content_evidence.episode_hypotheses[1]) episode from item),
e as (select scraped.tmdb_id cid, scraped.season_number season, scraped.episode_number episode, min(scraped.episode_name) episode_name from item where media_type = 'TvShow' and scraped.tmdb_id is not null group by 1, 2, 3)
select b.id, b.cid series_id, h.season, h.episode, e.episode_name, round(case when e.cid is not null then greatest(conf, 0.95::float) else conf end::double, 5) confidence from best b join h using (id) left join e on e.cid = b.cid and e.season = h.season and e.episode = h.episode"""
)
def episode_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of each episode, and the episode's name where it is known."""
    asked = _series(spark, sf_dir)
    chosen = identity.choose(asked.select("id", "c_id", "score", "rank")).join(asked.select("id", "season", "episode").distinct(), "id")
    known = table(spark, sf_dir, "media_item").filter("media_type = 'TvShow' and scraped.tmdb_id is not null").select(F.col("scraped.tmdb_id").alias("series_id"), F.col("scraped.season_number").alias("season"), F.col("scraped.episode_number").alias("episode"), F.col("scraped.episode_name").alias("episode_name"))
    found = identity.with_episodes(chosen, known)
    return found.select("id", F.col("c_id").alias("series_id"), "season", "episode", "episode_name", F.round(F.col("confidence").cast("double"), 5).alias("confidence"))


@query(
    _ITEM
    + _FILM_SQL
    + """, v as (select vec_id, embedding::double[] e from embeddings), s as (select r.id, r.cid, r.score, r.rank, round(list_cosine_similarity(a.e, b.e), 6)::float emb from r left join v a on a.vec_id = r.id left join v b on b.vec_id = r.cid where rank <= 5),
k as (select *, count(*) over (partition by id) n, row_number() over (partition by id order by (score + (coalesce(emb, 0::float) * 0.12::float)::float)::float desc, rank desc) o from s)
select id, cid tmdb_id, round(score::double, 5) score, round(emb::double, 5) embedding, round(case when n = 1 then 0.9::float else greatest(0.9::float, least(greatest(((0.62::float + (score * 0.18::float)::float)::float + (coalesce(emb, 0::float) * 0.08::float)::float)::float, 0.62::float), 0.97::float)) end::double, 5) confidence from k where o = 1"""
)
def film_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The film to take for each film item, by score and by how alike their vectors are."""
    asked = items(spark, sf_dir, "id", F.col("parsed.raw_title").alias("title"), F.col("parsed.year").alias("year"), F.lit(None).cast("int").alias("season"), "media_type", F.col("content_evidence.title_candidates").alias("seen")).filter("media_type = 'Movie'")
    films = table(spark, sf_dir, "tmdb_movie").select("id", "title", F.col("original_title").alias("original"), F.expr("try_cast(substring(release_date, 1, 4) as int)").alias("year"), F.col("vote_average").alias("rating")).distinct()
    met = linking.lookups(asked, films).select("id", "c_id", "score", "rank")
    vector = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").cast("array<double>").alias("e"))
    alike = met.join(vector.select(F.col("v").alias("id"), F.col("e").alias("a")), "id").join(vector.select(F.col("v").alias("c_id"), F.col("e").alias("b")), "c_id").select("id", "c_id", F.round(scoring.cosine(F.col("a"), F.col("b")), 6).alias("embedding"))
    chosen = identity.choose(met, alike)
    five = lambda c: F.round(F.col(c).cast("double"), 5).alias(c)
    return chosen.select("id", F.col("c_id").alias("tmdb_id"), five("score"), five("embedding"), five("confidence"))


@query(
    _ITEM
    + f""", q as (select id, trim(replace(replace(replace(parsed.raw_title, '.', ' '), '_', ' '), '  ', ' ')) t from item where media_type = 'Music' and parsed.raw_title is not null),
d as (select id, t, unnest([' - ', ' – ', ' — ']) d, unnest([0, 1, 2]) p from q),
c as (select id, p, trim(t[:instr(t, d) - 1]) artist, trim(t[instr(t, d) + 3:]) title from d where instr(t, d) > 0),
k as (select id, (row_number() over (partition by id order by p) - 1)::int pos, artist, title from c where artist <> '' and title <> ''),
w as (select id, t, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') ws from q where id not in (select id from k)),
mq as (select * from k union all select id, 0, case when len(ws) >= 2 then ws[1] else t end, case when len(ws) >= 2 then array_to_string(ws[2:], ' ') else t end from w
  union all select id, 9, scraped.artist, scraped.title from item where media_type = 'Music' and scraped is not null),
qq as (select id, pos, lower({library._bare_sql("artist")}) a, lower({library._bare_sql("title")}) b from mq),
rec as (select distinct id rid, artist_credit[1].name artist, title, releases[1].title album, try_cast(releases[1].date[:4] as int) "year" from mb_recording),
rr as (select *, lower({library._bare_sql("artist")}) a, lower({library._bare_sql("title")}) b from rec)
select id, pos::int pos, rid recording_id, album, "year", 0.86::double confidence from qq join rr using (a, b) where a <> '' and b <> '' qualify row_number() over (partition by id order by pos, rid) = 1"""
)
def recording_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recording of each music item by artist and title: as its name gives them, else as they were looked up before."""
    raw = items(spark, sf_dir, "id", "media_type", F.col("parsed.raw_title").alias("t"), F.col("scraped.artist").alias("artist"), F.col("scraped.title").alias("title"), F.col("scraped").isNotNull().alias("known")).filter("media_type = 'Music'")
    asked = raw.filter("t is not null").select("id", F.posexplode(titles.artist_and_title(F.col("t"))).alias("pos", "q")).select("id", "pos", "q.artist", "q.title").unionByName(raw.filter("known").select("id", F.lit(9).alias("pos"), "artist", "title"))
    first = F.get("releases", F.lit(0))
    known = table(spark, sf_dir, "mb_recording").select(F.col("id").alias("c_id"), F.get("artist_credit", F.lit(0))["name"].alias("artist"), "title", first["title"].alias("album"), F.substring(first["date"], 1, 4).try_cast("int").alias("year"))
    return identity.first_hits(asked, known, ["artist", "title"]).select("id", "pos", F.col("c_id").alias("recording_id"), "album", "year", F.lit(identity.SOURCE_CONFIDENCE["MusicBrainz"]).alias("confidence"))


@query(
    f"""with rec as (select distinct id rid, artist_credit[1].name artist, title, releases[1].title album, try_cast(releases[1].date[:4] as int) "year" from mb_recording),
rr as (select *, lower({library._bare_sql("artist")}) a, lower({library._bare_sql("title")}) b from rec), told as (select rid id, trim(replace(replace(replace(artist || ' - ' || title, '.', ' '), '_', ' '), '  ', ' ')) t from rec where artist is not null and title is not null),
cuts as (select id, p, trim(t[:instr(t, d) - 1]) artist, trim(t[instr(t, d) + 3:]) title from (select *, unnest([' - ', ' – ', ' — ']) d, unnest([0, 1, 2]) p from told) where instr(t, d) > 0),
q as (select id, (row_number() over (partition by id order by p) - 1)::int pos, lower({library._bare_sql("artist")}) a, lower({library._bare_sql("title")}) b from cuts where artist <> '' and title <> '')
select id, pos, rid recording_id, album, "year" from q join rr using (a, b) where a <> '' and b <> '' qualify row_number() over (partition by id order by pos, rid) = 1"""
)
def recording_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recording that each recording's name, written as `artist - title`, leads to: the first of those called alike."""
    first = F.get("releases", F.lit(0))
    known = table(spark, sf_dir, "mb_recording").select(F.col("id").alias("c_id"), F.get("artist_credit", F.lit(0))["name"].alias("artist"), "title", first["title"].alias("album"), F.substring(first["date"], 1, 4).try_cast("int").alias("year"))
    named = known.filter("artist is not null and title is not null").select(F.col("c_id").alias("id"), F.posexplode(titles.artist_and_title(F.concat_ws(" - ", "artist", "title"))).alias("pos", "q"))
    return identity.first_hits(named.select("id", "pos", "q.artist", "q.title"), known, ["artist", "title"]).select("id", "pos", F.col("c_id").alias("recording_id"), "album", "year")


@query(
    _ITEM
    + f""", b as (select coalesce(scraped.openlibrary_id, 'item:' || id) bid, scraped.title title, min(scraped.author) author, min(scraped."year") "year" from item where scraped.source = 'OpenLibrary' group by 1, 2),
bk as (select *, lower({library._bare_sql("title")}) t from b), q as (select id, lower({library._bare_sql("parsed.raw_title")}) t from item where media_type = 'Novel' and parsed.raw_title is not null)
select id, bid book_id, author, "year", 0.83::double confidence from q join bk using (t) where t <> '' qualify row_number() over (partition by id order by bid) = 1"""
)
def book_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book of each novel by its title, among those looked up before."""
    rows = table(spark, sf_dir, "media_item").filter("media_type = 'Novel'")
    key = F.coalesce("scraped.openlibrary_id", F.concat(F.lit("item:"), F.col("id").cast("string")))
    known = table(spark, sf_dir, "media_item").filter("scraped.source = 'OpenLibrary'").groupBy(key.alias("c_id"), F.col("scraped.title").alias("title")).agg(F.min("scraped.author").alias("author"), F.min("scraped.year").alias("year"))
    asked = rows.filter("parsed.raw_title is not null").select("id", F.lit(0).alias("pos"), F.col("parsed.raw_title").alias("title")).distinct()
    return identity.first_hits(asked, known, ["title"]).select("id", F.col("c_id").alias("book_id"), "author", "year", F.lit(identity.SOURCE_CONFIDENCE["OpenLibrary"]).alias("confidence"))


@query(_ITEM + 'select id, parsed.raw_title title, parsed.year "year", parsed.season season, parsed.episode episode, round(least(greatest((0.30::float + (parsed.confidence * 0.35::float)::float)::float, 0.30::float), 0.62::float)::double, 6) confidence from item where trim(parsed.raw_title) <> \'\'')
def guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is assumed of items that no source knows."""
    p = F.col("parsed")
    rows = items(spark, sf_dir, "id", p["raw_title"].alias("title"), p["year"].alias("year"), p["season"].alias("season"), p["episode"].alias("episode"), p["confidence"].alias("c")).filter("trim(title) <> ''")
    return rows.select("id", "title", "year", "season", "episode", F.round(identity.guess(F.col("c")).cast("double"), 6).alias("confidence"))


def _form_sql(x: str) -> str:
    return f"lower({library._bare_sql(x)})"


_SEEN_SQL = "list_filter(list_transform(coalesce(content_evidence.title_candidates, []), lambda x: " + _form_sql("x").replace("lambda x:", "lambda v:").replace("x <> ''", "v <> ''").replace("lower(x) not", "lower(v) not") + "), lambda x: x <> '')"


@query(
    _ITEM
    + f""", one as (select id, media_type kind, content_evidence ce, scraped s, identity_resolution.candidates cs, {_SEEN_SQL} seen, parsed p from item),
un as (select id, unnest(cs) c, unnest(range(len(cs))) i from one), good as (select * from un where c is not null),
ord as (select *, row_number() over (partition by id order by c.score desc nulls last, i) o from good),
two as (select id, max(c.score) filter (o = 1) s1, max(c.score) filter (o = 2) s2, count(*) n from ord group by id), fst as (select id, c from ord where o = 1),
best as (select one.*, two.n, two.s1, two.s2, coalesce(fst.c.title, case when fst.id is null then s.title end) bt, case when fst.id is null then s.season_number else fst.c.season end bs, case when fst.id is null then s.episode_number else fst.c.episode end be,
  case when fst.id is null then s.episode_name else fst.c.episode_title end bn, case when fst.id is null then least(greatest((s.confidence + case s.source when 'LocalNfo' then 0.08 when 'Tmdb' then 0.06 when 'MusicBrainz' then 0.06 when 'OpenLibrary' then 0.06 when 'AiAssist' then -0.05 when 'Guess' then -0.12 else 0 end::float)::float, 0::float), 1::float) else fst.c.score end bsc, fst.id is null and s is null nobest
  from one left join two using (id) left join fst using (id)),
j as (select *, (case when ce.container.title is not null or len(ce.container.chapters) > 0 or len(ce.container.track_titles) > 0 then 1 else 0 end + case when len(ce.subtitles) > 0 then 1 else 0 end
  + case when len(list_filter(coalesce(ce.visual, []), lambda v: len(v.text_hits) > 0)) > 0 then 1 else 0 end + case when len(list_filter(coalesce(ce.audio, []), lambda v: len(v.transcript_hits) > 0)) > 0 then 1 else 0 end) strong,
  coalesce(n > 1 and abs(s1 - s2)::float < 0.18::float, false) amb, {_form_sql("bt")} bf, coalesce({_form_sql("bn")}, '') ef from best),
t as (select *, coalesce(len(list_filter(seen, lambda x: x = bf or (ef <> '' and x = ef) or contains(bf, x) or contains(x, bf))) > 0, false) tm, coalesce(list_contains(ce.season_hypotheses, bs), false) sm, coalesce(list_contains(ce.episode_hypotheses, be), false) em from j),
u as (select *, case when nobest then 0 else tm::int + sm::int + em::int end corr, case kind when 'TvShow' then (sm and em) or (tm and em) or (tm and sm and bn is not null) when 'Movie' then tm else false end fits from t)
select id, strong strong_sources, corr corroboration, amb ambiguous, case when nobest or strong = 0 then 'InsufficientEvidence' when amb then 'AmbiguousCandidates' when strong >= 2 and corr >= 2 and coalesce(bsc >= 1.05::float, false) and coalesce(fits, false) then 'Confirmed' else 'HighConfidenceCandidate' end state,
  coalesce(p.season, ce.season_hypotheses[1]) season_hint, coalesce(p.episode, ce.episode_hypotheses[1]) episode_hint from u"""
)
def identity_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure the identity of each item is, by its candidates and its content."""
    p, c = F.col("parsed"), F.col("content_evidence")
    judged = identity.resolve(F.col("media_type"), F.col("scraped"), F.col("identity_resolution.candidates"), c)
    rows = table(spark, sf_dir, "media_item").select("id", judged.alias("r"), identity.hint(p["season"], c["season_hypotheses"]).alias("season_hint"), identity.hint(p["episode"], c["episode_hypotheses"]).alias("episode_hint"))
    return rows.select("id", "r.strong_sources", "r.corroboration", "r.ambiguous", "r.state", "season_hint", "episode_hint").distinct()


@query(
    _ITEM
    + f""", un as (select id, media_type kind, parsed p, coalesce(parsed.season, content_evidence.season_hypotheses[1]) sh, coalesce(parsed.episode, content_evidence.episode_hypotheses[1]) eh, {_SEEN_SQL} seen, {_form_sql("parsed.raw_title")} own, unnest(identity_resolution.candidates) c, unnest(range(len(identity_resolution.candidates))) pos from item),
f as (select *, {_form_sql("c.title")} theirs from un where c is not null and p is not null), h as (select *, list_position(list_transform(seen, lambda s: s = theirs), true) hit from f)
select id, pos::int pos, round((coalesce(case when own <> '' and theirs = own then 1.2::double when own <> '' and (contains(theirs, own) or contains(own, theirs)) then 0.7::double else 0 end, 0) + case when p.year is null or c.year is null then 0 when p.year = c.year then 0.45::double when abs(p.year - c.year) = 1 then 0.12::double else -0.25::double end
  + case when kind = 'TvShow' and sh = c.season then 0.18::double else 0 end + case when kind = 'TvShow' and eh = c.episode then 0.22::double else 0 end
  + 0.18::double * coalesce(len(list_filter(case when hit > 0 then seen[:hit - 1] else seen end, lambda s: contains(theirs, s) or contains(s, theirs))), 0) + case when hit > 0 then 0.48::double else 0 end)::float::double, 5) score from h"""
)
def identity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each candidate of an item fits it, seasons and episodes with it."""
    p, ce, none = F.col("parsed"), F.col("content_evidence"), F.lit(None)
    rows = table(spark, sf_dir, "media_item").filter("parsed is not null").select("id", "media_type", p["raw_title"].alias("t"), p["year"].alias("y"), identity.hint(p["season"], ce["season_hypotheses"]).alias("s"), identity.hint(p["episode"], ce["episode_hypotheses"]).alias("e"), ce["title_candidates"].alias("seen"), F.posexplode("identity_resolution.candidates").alias("pos", "c")).filter("c is not null")
    score = linking.candidate_score(F.col("t"), F.col("y"), F.col("s"), F.col("media_type"), F.col("seen"), F.col("c.title"), none.cast("string"), F.col("c.year"), none.cast("bigint"), none.cast("double"), F.col("e"), F.col("c.season"), F.col("c.episode"))
    return rows.select("id", "pos", F.round(score.cast("double"), 5).alias("score")).distinct()


# -- caches --------------------------------------------------------------------------------------


@query(
    _ITEM
    + """, k as (select id, coalesce(path, '') || ':' || coalesce(file_size::varchar, '') || ':' || coalesce(floor(epoch(mtime))::bigint::varchar, '') key, hash from item), c as (select key, max(hash.full_hash) full_hash from k where hash is not null group by key)
select id, k.key, c.full_hash, c.key is not null hit from k left join c on c.key = k.key"""
)
def hash_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their hash from a cache by path, size and time, where there is one."""
    seconds = F.floor(F.unix_micros(F.col("mtime").cast("timestamp")) / 1_000_000)
    keyed = items(spark, sf_dir, "id", linking.cache_key(F.col("path"), F.col("file_size"), seconds).alias("key"), F.col("hash.full_hash").alias("full_hash"), F.col("hash").isNotNull().alias("hashed"))
    cache = keyed.filter("hashed").groupBy("key").agg(F.max("full_hash").alias("full_hash"), F.lit(True).alias("hit"))
    found, _ = linking.with_cache(keyed.select("id", "key"), cache, ["key"])
    return found.select("id", "key", "full_hash", F.coalesce("hit", F.lit(False)).alias("hit"))


@query(
    _ITEM
    + """, k as (select id, coalesce(media_type, '') || ':' || trim(parsed.raw_title) || ':' || coalesce(parsed.year::varchar, '') || ':' || coalesce(parsed.season::varchar, '') || ':' || coalesce(parsed.episode::varchar, '') key, scraped from item where parsed.raw_title is not null),
c as (select key, max(scraped.title) title from k where scraped is not null group by key) select id, c.title, c.key is not null hit from k left join c on c.key = k.key"""
)
def scrape_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a title looked up before for the same name."""
    p = F.col("parsed")
    keyed = items(spark, sf_dir, "id", linking.cache_key(F.col("media_type"), F.trim(p["raw_title"]), p["year"], p["season"], p["episode"]).alias("key"), p["raw_title"].alias("raw"), F.col("scraped.title").alias("title"), F.col("scraped").isNotNull().alias("known")).filter("raw is not null")
    cache = keyed.filter("known").groupBy("key").agg(F.max("title").alias("title"), F.lit(True).alias("hit"))
    return linking.with_cache(keyed.select("id", "key"), cache, ["key"])[0].select("id", "title", F.coalesce("hit", F.lit(False)).alias("hit"))


# -- names and content ---------------------------------------------------------------------------


@query(_ITEM + library._NAMES.replace("select id, case when got is", ", told as (select id, case when got is", 1) + """)
select t.id, case when season is not null or episode is not null then 'TvShow' else media_type end kind, array_to_string(list_filter(case form
  when 'sxxexx' then ['matched TV pattern SxxExx', 'detected year ' || "year", 'detected resolution tag ' || resolution, 'detected codec tag ' || codec] when 'nxnn' then ['matched TV pattern xxXyy', 'detected year ' || "year", 'detected source tag ' || source]
  when 'bracket_zh' then ['matched bracketed Chinese season/episode pattern', 'detected release group ' || release_group] when 'bracket_en' then ['matched bracketed English season/episode pattern', 'detected resolution tag ' || resolution]
  when 'movie' then ['matched movie title + year pattern', 'validated year ' || "year", 'detected source tag ' || source] else ['fallback parse after stripping known media tags', 'no season/episode or title-year anchor matched'] end, lambda x: x is not null), '; ') reasons
from told t join item using (id)""")
def named_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each item after its name is read, and what led to that reading."""
    rows = items(spark, sf_dir, "id", "path", "media_type").filter("path is not null").select("id", "media_type", identify.identify(paths.stem(F.col("path"))).alias("n"))
    return rows.select("id", identify.kind_after(F.col("media_type"), F.col("n")).alias("kind"), F.array_join(identify.reasons(F.col("n")), "; ").alias("reasons"))


@query(
    _ITEM
    + r""", ce as (select id, content_evidence c from item where content_evidence is not null),
raw as (select id, 0 o, 0 i, 0 k, c.container.title x, false short from ce union all select id, 1, 0, 0, c.container.comment, true from ce union all select id, 2, i, 0, x, true from (select id, unnest(c.container.chapters) x, unnest(range(len(c.container.chapters))) i from ce)
  union all select id, 3, i, k, x, false from (select id, i, unnest(s.title_candidates) x, unnest(range(len(s.title_candidates))) k from (select id, unnest(c.subtitles) s, unnest(range(len(c.subtitles))) i from ce))),
f as (select *, trim(regexp_replace(regexp_replace(regexp_replace(trim(x), '^[-:|"'']+|[-:|"'']+$', '', 'g'), '[._]+', ' ', 'g'), '\s+', ' ', 'g')) t from raw where x is not null),
g as (select * from f where t <> '' and (not short or (len(list_filter(string_split(t, ' '), lambda w: w <> '')) <= 10 and strlen(t) <= 64))),
d as (select *, row_number() over (partition by id, t order by o, i, k) n from g)
select id, (row_number() over (partition by id order by o, i, k) - 1)::int pos, t title from d where n = 1"""
)
def container_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles that an item's container, comment, chapters and subtitles name, in order."""
    rows = items(spark, sf_dir, "id", evidence.content_titles(F.col("content_evidence")).alias("t"), F.col("content_evidence").isNotNull().alias("some")).filter("some")
    return rows.select("id", F.posexplode("t").alias("pos", "title"))


_FORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(trim({0}), '^[-:|"'']+|[-:|"'']+$', '', 'g'), '[._]+', ' ', 'g'), '\s+', ' ', 'g'))"""
_MAY = "(length({0}) between 2 and 64 and not starts_with(lower({0}), 'episode ') and not starts_with(lower({0}), 'season ') and not contains(lower({0}), 'subtitle') and not contains(lower({0}), 'dialogue') and not contains(lower({0}), 'commentary') and regexp_matches({0}, '\\p{{L}}'))"
_ASCII = "regexp_full_match({0}, '[\\x00-\\x7f]*')"
_HAN = "regexp_matches({0}, '[\\x{{4E00}}-\\x{{9FFF}}\\x{{3400}}-\\x{{4DBF}}\\x{{3040}}-\\x{{30FF}}\\x{{AC00}}-\\x{{D7AF}}]')"
_PATTERNS = [f"trim(regexp_extract(l, '{p}', 1))" for p in library._LINE_FORMS]


@query(
    _ITEM
    + rf""", lines as (select 'item:' || id key, parsed.raw_title || ' - S' || {_digits("parsed.season")} || 'E' || {_digits("parsed.episode")} l from item where parsed.season is not null and parsed.episode is not null and parsed.raw_title is not null
  union select 'film:' || id, title || ' / ' || original_title from tmdb_movie where title is not null and original_title is not null),
e as (select *, case when regexp_matches(l, '(?i)S\d{{1,2}}E\d{{1,3}}') then regexp_extract(l, '(?i)S\d{{1,2}}E(\d{{1,3}})', 1)::int else coalesce(nullif(regexp_extract(l, '(?i)(?:Episode|EP|E)\s*(\d{{1,3}})', 1), ''), nullif(regexp_extract(l, '第\s*(\d{{1,3}})\s*集', 1), ''))::int end ep, trim(string_split_regex(l, '[-|:]')[1]) pre from lines),
raw as (select key, unnest([{", ".join(_PATTERNS[:-4])}, case when ep is not null and strlen(pre) between 4 and 48 and not contains(lower(pre), 'episode') and not contains(pre, ep::varchar) then pre else '' end, {", ".join(_PATTERNS[-4:])}]) x, unnest(range(15)) o from e),
cuts as (select key, l, unnest([' / ', ' | ', ' - ', ' – ', ' — ', '·', '：', ':']) sep, unnest(range(8)) k from lines),
sides as (select key, k, {_FORM.format("l[:instr(l, sep) - 1]")} a, {_FORM.format("l[instr(l, sep) + length(sep):]")} b from cuts where instr(l, sep) > 0),
pairs as (select * from sides where {_MAY.format("a")} and {_MAY.format("b")} and ({_ASCII.format("a")} <> {_ASCII.format("b")} or {_HAN.format("a")} <> {_HAN.format("b")})),
every as (select key, o, x from raw where x <> '' union all select key, 100 + 2 * k, a from pairs union all select key, 101 + 2 * k, b from pairs),
f as (select key, o, {_FORM.format("x")} t from every), g as (select *, trim(regexp_replace(regexp_replace(lower(t), '[·:：\-_''"“”‘’《》()\[\]]', ' ', 'g'), '\s+', ' ', 'g')) alias from f where t <> '' and {_MAY.format("t")}),
d as (select *, row_number() over (partition by key, alias order by o) r from g where alias <> '')
select key, (row_number() over (partition by key order by o) - 1)::int pos, t title from d where r = 1"""
)
def line_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that lines name: of an episode's title with its number, and of a film's title in two languages."""
    p, two = F.col("parsed"), lambda c: F.format_string("%02d", c)
    told = items(spark, sf_dir, F.concat(F.lit("item:"), F.col("id").cast("string")).alias("key"), F.when(p["season"].isNotNull() & p["episode"].isNotNull(), F.concat(p["raw_title"], F.lit(" - S"), two(p["season"]), F.lit("E"), two(p["episode"]))).alias("line"))
    films = table(spark, sf_dir, "tmdb_movie").select(F.concat(F.lit("film:"), F.col("id").cast("string")).alias("key"), F.concat("title", F.lit(" / "), "original_title").alias("line")).distinct()
    lines = told.unionByName(films).filter("line is not null")
    return lines.select("key", F.posexplode(evidence.line_titles(F.col("line"), F.lit(None).cast("string"))).alias("pos", "title"))


# -- duplicates ----------------------------------------------------------------------------------

_GROUPS = (
    library._EFFECTIVE
    + """, times as (select id, max(mtime) mtime from item group by id),
ex as (select 'hash:' || hash.full_hash content_id, 'Exact' kind, ef.* from ef where hash.full_hash is not null qualify count(*) over (partition by hash.full_hash) > 1),
ve as (select version_key content_id, 'Version' kind, ef.* from ef where version_key is not null window g as (partition by version_key) qualify count(*) over g > 1 and not (count(hash.full_hash) over g = count(*) over g and min(hash.full_hash) over g = max(hash.full_hash) over g)),
al as (select a.*, times.mtime from (select content_id, kind, id, path, effective, q, trust, mc, file_size from ex union all select content_id, kind, id, path, effective, q, trust, mc, file_size from ve) a join times using (id)),
rk as (select *, count(*) over (partition by content_id, kind) n, row_number() over (partition by content_id, kind order by effective desc, q desc, trust desc, mc desc, file_size desc nulls last, id desc) hq, row_number() over (partition by content_id, kind order by mtime desc nulls last, id desc) nw,
  row_number() over (partition by content_id, kind order by file_size desc nulls last, id desc) lg from al)
"""
)


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.members(dedup.judged(table(spark, sf_dir, "media_item"), F.col("mtime")))


@query(
    _ITEM
    + _GROUPS
    + """, won as (select content_id, kind, 'HighestQuality' strategy, n, max(id) filter (hq = 1) keep_id from rk group by all union all select content_id, kind, 'Newest', n, max(id) filter (nw = 1 and mtime is not null) from rk group by all
  union all select content_id, kind, 'Largest', n, max(id) filter (lg = 1) from rk group by all union all select content_id, kind, 'Manual', n, null from rk group by all)
select content_id, kind, strategy, n, keep_id, n - (keep_id is not null)::int drops from won"""
)
def duplicate_keeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item that each strategy keeps of each exact and version group."""
    return dedup.kept(_grouped(spark, sf_dir)).drop("keep_path")


@query(
    _ITEM
    + _GROUPS
    + "select a.content_id, a.kind, a.id, b.id keep_id, regexp_extract(b.path, '([^/]*)$', 1) keep_name from rk a join rk b on a.content_id = b.content_id and a.kind = b.kind and b.hq = 1 where a.hq > 1"
)
def duplicate_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item that is dropped for a better one, with that one."""
    grouped = _grouped(spark, sf_dir)
    return dedup.removals(grouped, dedup.kept(grouped, ["HighestQuality"]))


# -- reports -------------------------------------------------------------------------------------

_VALID = """valid as (select distinct content_id, item_index, is_keep from duplicate_item where content_id is not null and item_index is not null qualify dense_rank() over (partition by content_id, item_index order by decided_at desc nulls last) = 1)"""


@query("with " + _VALID + " select content_id, count(*) items, count_if(is_keep is not true) pending from valid group by content_id")
def pending_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items of each group are not to be kept."""
    rows = dedup.latest_decisions(table(spark, sf_dir, "duplicate_item"))
    return rows.groupBy("content_id").agg(F.count("*").alias("items"), F.count_if(~F.coalesce("is_keep", F.lit(False))).alias("pending"))


@query(
    _ITEM
    + _TRUST
    + _RENAMES
    + library._ORGANIZED
    + """, mv as (select * from og where new_path <> old_path), pl as (select id, new_path, count(*) over (partition by new_path) > 1 or (new_path in (select path from item where path is not null) and new_path not in (select old_path from p where old_path is not null)) bad from p)
select 'rename' command, count(*) entries, count_if(not bad) ready, count_if(bad) blocked, 0 guarded from pl union all select 'organize', count(*), count_if(n = 1), count_if(n > 1), 0 from (select count(*) over (partition by new_path) n from mv)
union all select 'dedup', count(*), count_if(not g), 0, count_if(g) from (select distinct content_id, coalesce(len(guardrails) > 0, false) g from duplicate_group)"""
)
def execution_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries of each command are ready, blocked by a conflict or guarded."""
    none = F.lit(False)
    plans = planning.conflicts(_rename_plans(spark, sf_dir), items(spark, sf_dir, "path"))
    moves = planning.conflicts(planning.organize_plan(named_items(spark, sf_dir), "/library"))
    groups = table(spark, sf_dir, "duplicate_group").select("content_id", F.coalesce(F.size("guardrails") > 0, none).alias("g")).distinct()
    rows = [("rename", planning.execution_summary(plans, (F.col("wanted") > 1) | F.col("occupied"))), ("organize", planning.execution_summary(moves, F.col("wanted") > 1)), ("dedup", planning.execution_summary(groups, none, F.col("g")))]
    out = [x.select(F.lit(name).alias("command"), "*") for name, x in rows]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    _ITEM
    + """, pa as (select id, rename_plan r from item)
select (select count(*) from (select distinct content_id from duplicate_group)) duplicate_groups, (select count(*) from (select distinct content_id from duplicate_group where len(guardrails) > 0)) guarded_groups, count(r) renames, count_if(len(r.conflicts) > 0) renames_blocked, sum(coalesce(len(r.subtitle_plans), 0))::bigint subtitles, sum(coalesce(len(r.directory_plans), 0))::bigint folders from pa"""
)
def analysis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row over the stored groups and plans."""
    groups = table(spark, sf_dir, "duplicate_group").groupBy("content_id").agg(F.max(F.coalesce(F.size("guardrails") > 0, F.lit(False))).alias("g")).agg(F.count("*").alias("duplicate_groups"), F.count_if("g").alias("guarded_groups"))
    r, size = F.col("rename_plan"), lambda c: F.coalesce(F.size(c), F.lit(0))
    narrow = items(spark, sf_dir, "id", r.isNotNull().alias("r"), size(r["conflicts"]).alias("c"), size(r["subtitle_plans"]).alias("s"), size(r["directory_plans"]).alias("d"))
    plans = narrow.agg(F.count_if("r").alias("renames"), F.count_if(F.col("c") > 0).alias("renames_blocked"), F.sum(F.greatest("s", F.lit(0))).alias("subtitles"), F.sum(F.greatest("d", F.lit(0))).alias("folders"))
    return groups.withColumn("one", F.lit(1)).join(plans.withColumn("one", F.lit(1)), "one").drop("one")  # one row each


@query("with " + _VALID + ", m as (select distinct id, path from media_item) select distinct v.content_id from valid v join m on m.id = v.item_index where contains(lower(v.content_id), 'harbor') or contains(lower(regexp_extract(m.path, '([^/]*)$', 1)), 'harbor')")
def search_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose id or a file of which holds a word."""
    rows = dedup.latest_decisions(table(spark, sf_dir, "duplicate_item")).select("content_id", F.col("item_index").alias("id")).join(items(spark, sf_dir, "id", "path"), "id")
    return planning.search(rows, "harbor", F.col("content_id"), paths.file_name(F.col("path"))).select("content_id").distinct()


@query(_ITEM + "select distinct id from item where contains(lower(regexp_extract(rename_plan.old_path, '([^/]*)$', 1)), 'lantern') or contains(lower(regexp_extract(rename_plan.new_path, '([^/]*)$', 1)), 'lantern') or len(list_filter(rename_plan.conflicts, lambda c: contains(lower(c), 'lantern'))) > 0")
def search_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored plans whose names or conflicts hold a word."""
    r = F.col("rename_plan")
    return planning.search(table(spark, sf_dir, "media_item"), "lantern", paths.file_name(r["old_path"]), paths.file_name(r["new_path"]), F.array_join(r["conflicts"], "\n")).select("id").distinct()


@query("with " + _VALID + ", w as (select distinct content_id from valid where item_index in (select min(item_index) from valid)) select v.content_id, v.item_index from valid v join w using (content_id)")
def groups_of_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups, with all their items, that hold the first item of any."""
    rows = dedup.latest_decisions(table(spark, sf_dir, "duplicate_item")).select("content_id", "item_index")
    wanted = rows.agg(F.min("item_index").alias("item_index"))
    return rows.join(rows.join(F.broadcast(wanted), "item_index", "left_semi").select("content_id").distinct(), "content_id", "left_semi")


@query(_ITEM + "select id, rename_plan.new_path new_path, coalesce(len(rename_plan.conflicts), 0)::int conflicts from item where rename_plan.old_path = (select min(rename_plan.old_path) from item)")
def plan_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored plan of one path, the first of all."""
    r = F.col("rename_plan")
    rows = items(spark, sf_dir, "id", r["old_path"].alias("old_path"), r["new_path"].alias("new_path"), F.coalesce(F.size(r["conflicts"]), F.lit(0)).alias("conflicts"))
    return rows.join(F.broadcast(rows.agg(F.min("old_path").alias("old_path"))), "old_path", "left_semi").select("id", "new_path", F.greatest("conflicts", F.lit(0)).alias("conflicts"))


@query(_ITEM + "select 'scan' command, 7 stage_count, count(*) item_count, count(*) scraped_items from item union all select 'scrape', 7, count(*), count(scraped) from item")
def pipeline_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items there are and how many were looked up, as a scan that asks for it and a lookup report it."""
    once = table(spark, sf_dir, "media_item").select("id", "path", F.when(F.col("scraped").isNotNull(), F.lit(1)).alias("scraped")).distinct()
    return planning.pipeline_summary(once, 7, True).select(F.lit("scan").alias("command"), "*").unionByName(planning.pipeline_summary(once, 7).select(F.lit("scrape").alias("command"), "*"))


_FIELD_SQL = """case when {p} is null and {s} is null then null when {p} is null or ({s} is not null and trusted) then 'Scraped' else 'Parsed' end {n}_origin,
  round(case when {p} is null and {s} is null then null when {p} is null or ({s} is not null and trusted) then coalesce(stt, 0::float) else coalesce(pt, 0::float) end::double, 5) {n}_confidence"""


@query(_ITEM + _TRUST + "select id, " + ",\n  ".join(_FIELD_SQL.format(p=p, s=s, n=n) for n, p, s in (("title", "ptitle", "stitle"), ("year", "p.year", "s.year"), ("season", "p.season", "s.season_number"), ("episode", "p.episode", "s.episode_number"))) + " from pref")
def decision_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the title, year, season and episode of each item are taken from, and how much that is trusted."""
    p, s, state = F.col("parsed"), F.col("scraped"), F.col("identity_resolution.confirmation_state")
    own, looked = scoring.clamp(p["confidence"]), scoring.scraped_authority(s["confidence"], s["source"], state)
    blank = lambda c: F.when(F.trim(c) != "", c)
    pairs = {"title": (blank(p["raw_title"]), blank(s["title"])), "year": (p["year"], s["year"]), "season": (p["season"], s["season_number"]), "episode": (p["episode"], s["episode_number"])}
    rows = items(spark, sf_dir, "id", *[scoring.preferred(a, own, b, looked).alias(n) for n, (a, b) in pairs.items()])
    return rows.select("id", *[c for n in pairs for c in (F.col(f"{n}.origin").alias(f"{n}_origin"), F.round(F.col(f"{n}.confidence").cast("double"), 5).alias(f"{n}_confidence"))])


@query(
    _ITEM
    + """, k as (select id, coalesce(path, '') || ':' || coalesce(file_size::varchar, '') || ':' || coalesce(floor(epoch(mtime))::bigint::varchar, '0') || ':' || coalesce(extension, '') key, content_evidence c from item), h as (select key, max(c.runtime_secs) runtime_secs from k where c is not null group by key)
select id, h.runtime_secs, h.key is not null hit from k left join h on h.key = k.key"""
)
def probe_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with what was found in the content of the same file before, by path, size, time and extension."""
    seconds = F.coalesce(F.floor(F.unix_micros(F.col("mtime").cast("timestamp")) / 1_000_000), F.lit(0))
    c = F.col("content_evidence")
    keyed = items(spark, sf_dir, "id", linking.cache_key(F.col("path"), F.col("file_size"), seconds, F.col("extension")).alias("key"), c["runtime_secs"].alias("runtime_secs"), c.isNotNull().alias("known"))
    cache = keyed.filter("known").groupBy("key").agg(F.max("runtime_secs").alias("runtime_secs"), F.lit(True).alias("hit"))
    return linking.with_cache(keyed.select("id", "key"), cache, ["key"])[0].select("id", "runtime_secs", F.coalesce("hit", F.lit(False)).alias("hit"))


@query(
    _ITEM
    + """, a as (select id, parsed p, scraped s, rename_plan r, least(greatest((scraped.confidence + case scraped.source when 'LocalNfo' then 0.08 when 'Tmdb' then 0.06 when 'MusicBrainz' then 0.06 when 'OpenLibrary' then 0.06 when 'AiAssist' then -0.05 when 'Guess' then -0.12 else 0 end::float)::float, 0::float), 1::float) au from item)
select distinct id, array_to_string(list_filter([case when p is null then 'identify: nothing read' end, case when p.confidence < 0.6::float then 'identify: low confidence' end, case when p is not null and p.year is null and p.season is null and p.episode is null then 'identify: no year and no episode' end,
  case when s is null then 'lookup: nothing found' end, case when s.confidence is not null and au < 0.72::float then 'lookup: low authority' end, case when s.source in ('Guess', 'AiAssist') then 'lookup: weak source' end,
  case when r is not null and coalesce(r.decision.title_confidence, 0::float) < 0.6::float then 'rename: low title confidence' end, case when len(r.conflicts) > 0 then 'rename: conflicts' end], lambda x: x is not null), '; ') doubts from a"""
)
def item_doubts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against the identity of each item and against its plan."""
    s = F.col("scraped")
    told = planning.doubts(F.col("parsed"), s, scoring.scraped_authority(s["confidence"], s["source"]), F.col("rename_plan"))
    return items(spark, sf_dir, "id", F.array_join(told, "; ").alias("doubts"))
