"""Queries of the ingest operators: feeds, normalisation, sitemaps, product pages, retagging, size back-fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import taxonomy as tx
from weftline.functions.expressions import to_int_price
from weftline.operators import normalize as nz
from weftline.plans.registry import query
from weftline.sources import tables as st
from weftline.sources.tables import feed, table


def _list(values) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _in(values) -> str:
    return "(" + _list(values)[1:-1] + ")"


def sql_lookup(table: dict[str, str], value: str) -> str:
    return "case " + " ".join(f"when {value} in {_in(listed)} then '{category}'" for category, listed in table.items()) + " end"


def sql_any(text: str, markers) -> str:
    return "(" + " or ".join(f"contains({text}, '{m}')" for m in markers) + ")"


def sql_words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_\\-]+')"


def sql_first(w: str) -> str:
    pair, head, english = sql_lookup(tx.COMPOUNDS, f"({w}[i] || ' ' || {w}[i + 1])"), sql_lookup(tx.HEAD_NOUNS, f"{w}[i]"), sql_lookup(tx.ENGLISH_WORDS, f"{w}[i]")
    return f"list_filter(list_transform(range(1, len({w}) + 1), lambda i: coalesce({pair}, {head}, {english})), lambda x: x is not null)[1]"


_PRICE = "(20000 + (k * 7919 + j * 1000) % 600000)"
FEED = f"""feed0 as (select p_partkey as k, {_list(st.FEED_STORES)}[p_partkey % 4 + 1] as store, case when p_partkey % 7 <> 0 then 'p' || (p_partkey % 1500) end as id,
  case when p_partkey % 5 = 0 then '' else 'h' || p_partkey end as handle0, case p_partkey % 4 when 0 then 'http://o/x' || p_partkey when 1 then '/products/u' || p_partkey || '/' when 2 then '' else 'u' || p_partkey end as url,
  case when p_partkey % 6 <> 0 then {_list(st.FEED_TITLES)}[p_partkey % 14 + 1] || ' ' || {_list(st.FEED_WORDS)}[(p_partkey // 14) % 7 + 1] end as title0, {_list(st.FEED_TITLES)}[p_partkey % 14 + 1] as name,
  trim({_list(st.FEED_TYPES)}[(p_partkey // 3) % 10 + 1]) as kind, ['tag' || (p_partkey % 5), {_list(st.FEED_TAGS)}[(p_partkey // 5) % 4 + 1]] as tags, '<p>Mô tả &amp; <b>x</b> ' || p_partkey || '</p>' as html,
  case when p_partkey % 11 = 0 then [] else ['http://x/i' || p_partkey || {_list(st.FEED_IMAGES)}[p_partkey % 5 + 1]] end as images from part),
feed1 as (select *, case when handle0 = '' then list_extract(string_split(rtrim(url, '/'), '/'), -1) else handle0 end as handle, trim(coalesce(title0, name)) as title from feed0),
raw as (select *, coalesce(id, handle) as product, case when url like 'http://%' then url when url like '/%' then 'http://' || store || url when handle <> '' then 'http://' || store || '/products/' || handle else '' end as link from feed1),
variants as (select k, j, case when j = 1 and k % 3 = 0 then '' else 'S' || k || '-' || j end as sku, round_even(({_PRICE} || {_list(st.FEED_CENTS)}[k % 3 + 1])::double, 0)::bigint as price,
  case when j % 2 = 0 then {_PRICE} + 10000 end as compare, (k + j) % 2 = 0 as available, {_list(st.FEED_COLORS)}[(k + j) % 4 + 1] as o1, {_list(st.FEED_SIZES)}[(k * j) % 5 + 1] as o2
  from (select p_partkey as k, unnest(range(1, p_partkey % 4 + 1)) as j from part))"""


def _raws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed(spark, sf_dir)
    raws = nz.raw_products(rows, F.concat(F.lit("http://"), "source_store_id"))
    return raws.withColumn("pos", F.regexp_extract("description_html", "([0-9]+)</p>", 1).cast("bigint"))


@query(f"with {FEED} select k as pos, store as source_store_id, product as source_product_id, handle, title, kind as product_type, array_to_string(tags, '|') as tags, link as product_url from raw")
def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raws(spark, sf_dir).select("pos", "source_store_id", "source_product_id", "handle", "title", "product_type", F.array_join("tags", "|").alias("tags"), "product_url")


_KIND = "regexp_replace(lower(kind), '[ \\t\\n]+', ' ', 'g')"
_STORE = " ".join(f"when store = '{s}' and {sql_lookup(t, 'kd')} is not null then {sql_lookup(t, 'kd')}" for s, t in tx.STORE_TYPES.items())
_PARTS = " ".join(f"when {sql_any('kd', listed)} then '{category}'" for category, listed in tx.TYPE_KEYWORDS)
RESOLVED = f"""kinds as (select *, {_KIND} as kd, {sql_words('title')} as tw, {sql_words('kind')} as kw, {sql_words("array_to_string(tags, ' ')")} as gw, lower(title || ' ' || kind) as tk, {sql_words("title || ' ' || kind")} as tkw from raw),
by_store as (select *, case when kd = '' then null {_STORE} when kd in {_in(tx.DROPPED_TYPES)} or {sql_any('kd', tx.DROPPED_MARKERS)} then 'drop'
  when {sql_lookup(tx.PRODUCT_TYPES, 'kd')} is not null then {sql_lookup(tx.PRODUCT_TYPES, 'kd')} {_PARTS} end as sc,
  case when not ({sql_any('lower(title)', tx.OUT_OF_SCOPE_TITLES)} or list_has_any(tw, {_list(tx.OUT_OF_SCOPE_WORDS)})) then coalesce({sql_first('tw')}, {sql_first('kw')}, {sql_first('gw')}) end as tc from kinds),
resolved as (select *, case when sc = 'drop' then null else coalesce(sc, tc) end as category from by_store),
gendered as (select *, case when {sql_any('tk', tx.KID_MARKERS)} or list_has_any(tkw, {_list(tx.KID_WORDS)}) then 'kid' when contains(tk, 'unisex') then 'unisex'
  when list_has_any(tkw, {_list(tx.MEN_WORDS)}) and (list_has_any(tkw, {_list(tx.WOMEN_WORDS)}) or contains(tk, 'phụ nữ')) then 'unisex' when list_has_any(tkw, {_list(tx.MEN_WORDS)}) then 'men'
  when list_has_any(tkw, {_list(tx.WOMEN_WORDS)}) or contains(tk, 'phụ nữ') then 'women' when category = 'dress' or {sql_any('tk', tx.WOMEN_GARMENTS)} then 'women'
  else coalesce(case store {' '.join(f"when '{s}' then '{g}'" for s, g in tx.STORE_GENDERS.items())} end, 'unisex') end as gender,
  case {' '.join(f"when {sql_any('ft', markers)} then '{band}'" for band, markers in tx.FORMALITY_MARKERS)} else 'casual' end as formality
  from (select *, lower(title || ' ' || kind || ' ' || array_to_string(tags, ' ')) as ft from resolved))"""


@query(f"with {FEED}, {RESOLVED} select k as pos, sc as store_category, tc as title_category, category, gender, formality from gendered")
def product_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, kind, tags, store = (F.col(c) for c in ("title", "product_type", "tags", "source_store_id"))
    rows = _raws(spark, sf_dir).withColumn("category", nz.resolve_category(title, kind, tags, store))
    return rows.select("pos", nz.store_category(kind, store).alias("store_category"), nz.title_category(title, kind, tags).alias("title_category"), "category", nz.infer_gender(title, kind, store, F.col("category")).alias("gender"), nz.infer_formality(title, kind, tags).alias("formality"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raws(spark, sf_dir).where("pos % 9 = 0").select(F.col("source_store_id").alias("store_id"), "source_product_id", F.concat(F.lit(nz.ITEM_PREFIX), F.lpad(F.col("pos").cast("string"), 5, "0")).alias("item_id"), "pos")
    return nz.link_map(rows, "pos")


_COLOR = ", ".join(f"case when regexp_matches(ct, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(names)})($|[^\\p{{L}}\\p{{N}}_])') then '{color}' end" for color, names in tx.COLOR_NAMES)
NORMAL = f"""known as (select store, product, arg_max('item_custom_' || lpad(k::varchar, 5, '0'), k) as known_id from raw where k % 9 = 0 group by 1, 2),
priced as (select k, min(price) filter (price > 0) as price, min(price) filter (price < compare) as sale, bool_or(available) as stock, (list(sku order by j) filter (sku <> ''))[1] as sku from variants group by k),
opts as (select k, list(struct_pack(o := o, s := is_size, a := available) order by j, n) as os from (select k, j, available, unnest([o1, o2]) as o, unnest([1, 2]) as n, unnest([o1, o2]) as oo from variants) v join lateral (select (regexp_matches(lower(v.o), 'size|kích|free') or regexp_matches(v.o, '^[XSMLxsml0-9.\\-/ ]{{1,8}}$')) as is_size) on true where o <> '' group by k),
good as (select g.*, p.price, p.sale, p.stock, p.sku, coalesce(os, []) as os, lower(concat_ws(' ', nullif(trim(title), ''), nullif(trim(kind), ''), array_to_string(tags, ' '))) as ct from gendered g join priced p using (k) left join opts using (k)
  where category is not null and len(images) > 0 and p.price between 30000 and 50000000),
fresh as (select store, product, row_number() over (order by min(k)) as n from good left join known using (store, product) where known_id is null group by 1, 2),
named as (select g.*, coalesce(known_id, 'item_custom_' || lpad((3000 + n)::varchar, 5, '0')) as item_id, list_concat([x.o for x in os if not x.s], list_filter([{_COLOR}], lambda c: c is not null)) as cs, [upper(x.o) for x in os if x.s] as ss, [upper(x.o) for x in os if x.s and x.a] as sa
  from good g left join known using (store, product) left join fresh using (store, product))"""


@query(f"""with {FEED}, {RESOLVED}, {NORMAL} select item_id, category, kind as source_product_type, gender, formality,
  'data/custom/catalog/images/' || item_id || case when regexp_matches(images[1], '(?i)\\.(jpe?g|png|webp)(\\?|$)') then '.' || replace(lower(regexp_extract(images[1], '(?i)\\.(jpe?g|png|webp)(\\?|$)', 1)), 'jpeg', 'jpg') else '.jpg' end as image_path,
  'Mô tả & x ' || k as desc_vi, array_to_string(list_filter(cs, lambda c, i: list_position([lower(x) for x in cs], lower(c)) = i)[1:8], '|') as colors, store as store_id, product as source_product_id, price as price_vnd, sale as sale_price_vnd,
  coalesce(sku, '') as sku, coalesce(stock, true) as in_stock, array_to_string(list_filter(ss, lambda c, i: list_position(ss, c) = i), '|') as available_sizes, array_to_string(list_filter(sa, lambda c, i: list_position(sa, c) = i), '|') as sizes_in_stock from named""")
def normalized_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nz.normalize_products(_raws(spark, sf_dir), "pos", _known(spark, sf_dir), 3001)
    joined = {c: F.array_join(c, "|").alias(c) for c in ("colors", "available_sizes", "sizes_in_stock")}
    wanted = ("item_id", "category", "source_product_type", "gender", "formality", "image_path", "desc_vi", "colors", "store_id", "source_product_id", "price_vnd", "sale_price_vnd", "sku", "in_stock", "available_sizes", "sizes_in_stock")
    return rows.select(*[joined.get(c, F.col(c)) for c in wanted])


@query("select coalesce(max(try_cast(regexp_extract(x, '^item_custom_([0-9]+)$', 1) as bigint)), 0) as max_index from (select case when p_partkey % 3 = 0 then 'item_custom_' || p_partkey when p_partkey % 3 = 1 then 'item_custom_x' || p_partkey else 'other_' || p_partkey end as x from part)")
def item_max_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("item_custom_"), k)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("item_custom_x"), k)).otherwise(F.concat(F.lit("other_"), k))
    return nz.max_index(table(spark, sf_dir, "part").select(name.alias("item_id")))


@query("""with x as (select o_orderkey, case o_orderkey % 6 when 0 then floor(o_totalprice)::bigint || ',000' when 1 then floor(o_totalprice)::bigint || '.5' when 2 then 'free' when 3 then '-5' when 4 then null else '0.4' end as p from orders)
select o_orderkey, case when round_even(try_cast(replace(p, ',', '') as double), 0) > 0 then round_even(try_cast(replace(p, ',', '') as double), 0)::bigint end as price from x""")
def feed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("o_orderkey") % 6, F.floor("o_totalprice").cast("bigint").cast("string")
    raw = F.when(k == 0, F.concat(n, F.lit(",000"))).when(k == 1, F.concat(n, F.lit(".5"))).when(k == 2, "free").when(k == 3, "-5").when(k == 4, F.lit(None)).otherwise("0.4")
    return table(spark, sf_dir, "orders").select("o_orderkey", to_int_price(raw).alias("price"))


_SITE = """sites as (select page_id // 10 as site, string_agg('<url><loc> ' || replace(case when page_id % 3 = 0 then regexp_replace(url, '^https?://[^/]*', 'http://www.shop.example') || '/products/a' || page_id % 50 when page_id % 3 = 1 then 'https://shop.example/x-ab' || page_id || '?q=1&r=2' else url end, '&', '&amp;') || '</loc>'
  || case when page_id % 2 = 0 then '<image:loc>http://i/' || page_id || '</image:loc><image:title>A <b>b</b>
 &lt;' || page_id || '</image:title>' else '' end || '</url>', '' order by page_id) as xml from pages group by 1)"""


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    text = k.cast("string")
    shop = F.concat(F.regexp_replace("url", "^https?://[^/]*", "http://www.shop.example"), F.lit("/products/a"), (k % 50).cast("string"))
    loc = F.replace(F.when(k % 3 == 0, shop).when(k % 3 == 1, F.concat(F.lit("https://shop.example/x-ab"), text, F.lit("?q=1&r=2"))).otherwise(F.col("url")), F.lit("&"), F.lit("&amp;"))
    image = F.when(k % 2 == 0, F.concat(F.lit("<image:loc>http://i/"), text, F.lit("</image:loc><image:title>A <b>b</b>\n &lt;"), text, F.lit("</image:title>"))).otherwise("")
    block = F.concat(F.lit("<url><loc> "), loc, F.lit("</loc>"), image, F.lit("</url>"))
    rows = table(spark, sf_dir, "pages").groupBy(F.floor(k / 10).alias("site")).agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), block.alias("x")))).alias("xs"))
    return rows.select("site", F.array_join(F.transform("xs", lambda x: x["x"]), "").alias("xml"))


@query(f"""with {_SITE}, blocks as (select unnest(regexp_extract_all(xml, '(?is)<url>.*?</url>')) as b from sites),
r as (select replace(trim(regexp_extract(b, '(?is)<loc>(.*?)</loc>', 1)), '&amp;', '&') as loc, nullif(regexp_extract(b, '<image:loc>(.*?)</image:loc>', 1), '') as image_url,
  nullif(replace(trim(regexp_replace(regexp_replace(regexp_extract(b, '(?s)<image:title>(.*?)</image:title>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '&lt;', '<'), '') as image_title from blocks),
p as (select *, lower(regexp_extract(loc, '^\\w+://[^/?#]*([^?#]*)', 1)) as path from r where contains(replace(regexp_extract(loc, '^\\w+://([^/?#]*)', 1), 'www.', ''), 'shop.example'))
select loc, arg_min(image_url, (image_url is null, image_url)) as image_url, arg_min(image_title, (image_url is null, image_url)) as image_title from p where regexp_matches(path, '/products?/|/[a-z0-9-]+(-[a-z]{{1,4}}[0-9]{{2,}}|-[0-9]{{4,}}|z[0-9]{{5,}})$') group by loc""")
def sitemap_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.product_pages(_site(spark, sf_dir), "xml", "https://www.shop.example")


_SHOP = """shop as (select page_id, 'https://shop.example/a/' || page_id || '/' as url, '<meta property="og:title" content="first"><META name=''og:title'' x="1" content="T &amp; ' || page_id || '">' || case when page_id % 4 <> 0 then '<meta property="og:image" content=" http://i/' || page_id || '.png ">' else '' end
  || case page_id % 3 when 0 then '"price": "' || (page_id * 997 % 90000) || '.00", "sale_price":' || (20000 + page_id * 31) when 1 then 'giá ' || (100 + page_id % 800) || '.000đ và 90.000 VND' else 'no' end || '<meta name="twitter:description" content="d' || page_id || '">' || html as html from pages)"""


def _shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    text = k.cast("string")
    image = F.when(k % 4 != 0, F.concat(F.lit('<meta property="og:image" content=" http://i/'), text, F.lit('.png ">'))).otherwise("")
    price = F.when(k % 3 == 0, F.concat(F.lit('"price": "'), (k * 997 % 90000).cast("string"), F.lit('.00", "sale_price":'), (20000 + k * 31).cast("string"))).when(k % 3 == 1, F.concat(F.lit("giá "), (100 + k % 800).cast("string"), F.lit(".000đ và 90.000 VND"))).otherwise("no")
    html = F.concat(F.lit("<meta property=\"og:title\" content=\"first\"><META name='og:title' x=\"1\" content=\"T &amp; "), text, F.lit('">'), image, price, F.lit('<meta name="twitter:description" content="d'), text, F.lit('">'), "html")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://shop.example/a/"), text, F.lit("/")).alias("url"), html.alias("html"))


_PAGE_PRICE = """priced as (select *, list_min(list_filter([try_cast(x as bigint) for x in regexp_extract_all(html, '(?i)(?:sale_price|original_price|price|final_price|retail_price)"?\\s*[:=]\\s*"?([0-9]{5,9})(?:\\.0+)?"?', 1)], lambda n: n between 30000 and 50000000)) as p1,
  list_min(list_filter([try_cast(replace(replace(x, '.', ''), ',', '') as bigint) for x in regexp_extract_all(html, '(?i)([0-9]{2,3}(?:[.,][0-9]{3}){1,2})\\s*(?:đ|Đ|VND|VNĐ)', 1)], lambda n: n between 30000 and 50000000)) as p2 from shop)"""


@query(f"""with {_SHOP}, {_PAGE_PRICE} select page_id::varchar as source_product_id, 'T & ' || page_id as title, 'd' || page_id as description_html, 'http://i/' || page_id || '.png' as image, coalesce(p1, p2)::varchar as price, url as product_url
from priced where page_id % 4 <> 0 and coalesce(p1, p2) is not null""")
def html_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nz.html_products(_shop(spark, sf_dir), F.lit("shop"), F.lit("Shop"))
    return rows.select("source_product_id", "title", "description_html", F.element_at("images", 1).alias("image"), F.element_at("variants", 1)["price"].alias("price"), "product_url")


@query(f"""with {FEED}, {RESOLVED}, cat as (select distinct 'i' || k as item_id, k, case k % 3 when 0 then 'top' when 1 then 'shoes' else 'bag' end as old_c, case when k % 2 = 0 then 'women' else 'men' end as old_g from raw),
firsts as (select store, product, arg_min((title, kind), k) from raw group by 1, 2),
n as (select old_c, old_g, case when c.k % 5 = 0 then old_c else coalesce(g.category, 'none') end as new_c, case when c.k % 5 = 0 then old_g else g.gender end as new_g from cat c join gendered g using (k))
select column_name as "column", change, count(*) as n from (select 'category' as column_name, old_c || ' -> ' || new_c as change from n where old_c <> new_c union all select 'gender', old_g || ' -> ' || new_g from n where old_g <> new_g) group by 1, 2""")
def retag_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose raw product is at hand are retagged; every fifth is not."""
    raws = _raws(spark, sf_dir).withColumn("source_product_id", F.col("pos").cast("string"))
    k = F.col("pos")
    items = raws.select(F.concat(F.lit("i"), k.cast("string")).alias("item_id"), F.when(k % 3 == 0, "top").when(k % 3 == 1, "shoes").otherwise("bag").alias("category"), F.when(k % 2 == 0, "women").otherwise("men").alias("gender"))
    links = raws.select(F.concat(F.lit("i"), k.cast("string")).alias("item_id"), F.col("source_store_id").alias("store_id"), "source_product_id", "pos")
    again = links.withColumn("pos", k + 1_000_000).withColumn("source_product_id", F.lit("none"))  # later links don't count
    return nz.retag(items, links.unionByName(again), raws.where("pos % 5 <> 0"), "pos")[2]


@query("""with l as (select o_orderkey as k, case when o_orderkey % 3 = 0 then [] else ['M'] end as s from orders), f as (select o_orderkey as k, [' m', 'XL', 'xl'] as s, ['xl'] as t from orders where o_orderkey % 2 = 0)
select l.k as item_id, array_to_string(case when len(l.s) = 0 and f.k is not null then ['M', 'XL'] else l.s end, '|') as available_sizes, array_to_string(case when len(l.s) = 0 and f.k is not null then ['XL'] else l.s end, '|') as sizes_in_stock from l left join f using (k)""")
def size_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    own = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("M")))
    orders = table(spark, sf_dir, "orders")
    links = orders.select(k.alias("item_id"), own.alias("available_sizes"), own.alias("sizes_in_stock"))
    found = orders.where(k % 2 == 0).select(k.alias("item_id"), F.array(F.lit(" m"), F.lit("XL"), F.lit("xl")).alias("sizes"), F.array(F.lit("xl")).alias("sizes_stock"))
    rows = nz.backfill_sizes(links, found)
    return rows.select("item_id", F.array_join("available_sizes", "|").alias("available_sizes"), F.array_join("sizes_in_stock", "|").alias("sizes_in_stock"))
