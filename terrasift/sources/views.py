"""Views of the base tables that stand for registries, rasters, labels and scores, in a form that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: {str} is the string type of the engine, {exploded} its form of one row per component of an embedding.
VIEWS: dict[str, str] = {
    "fx_regions": """
select n_nationkey as region_id,
  concat(lpad(cast(n_nationkey as {str}),3,'0'),'_',n_name) as region,
  n_nationkey*20000 as rx0,
  concat('urn:ogc:def:crs:EPSG::', cast(32630+n_nationkey%7 as {str})) as crs_urn
from nation
""",
    "fx_rasters": """
select g.region_id*5+k.r_regionkey as raster_id, g.region_id, g.region,
  case k.r_regionkey when 0 then 'Li' when 1 then 'Ae' when 2 then 'SpOr' when 3 then 'SpOr' else 'Or' end as modality,
  k.r_regionkey as file_ord,
  cast((1+(g.region_id+k.r_regionkey)%3)*0.5 as double) as px,
  3000+((g.region_id+k.r_regionkey)%5)*700 as width,
  2600+((g.region_id+k.r_regionkey)%4)*900 as height,
  cast(g.rx0+((g.region_id*3+k.r_regionkey)%11)*200 as double) as x_left,
  cast(6004000-((g.region_id+k.r_regionkey)%6)*200 as double) as y_top
from fx_regions g cross join region k
""",
    "fx_objects": """
select o.o_orderkey as object_id, r.region_id, r.region,
  case c.c_custkey%4 when 0 then 'Li' when 1 then 'Ae' when 2 then 'SpOr' else 'Or' end as modality,
  case substr(o.o_orderpriority,1,1) when '1' then 'kurgany_tselye' when '2' then 'kurgany_povrezhdennye'
    when '3' then 'gorodishcha' when '4' then 'fortifikatsii' else 'arkhitektury' end as class_name,
  case when o.o_orderkey%10=3 or r.region_id%5=2 then true else false end as shifted,
  cast(r.rx0+(o.o_orderkey*7919)%6000
    + case when o.o_orderkey%10=3 or r.region_id%5=2 then 5000000 else 0 end as double) as cx,
  cast(6000000+(o.o_orderkey*104729)%4000 as double) as cy,
  cast(6+(o.o_orderkey*31)%40 as double) as hw,
  cast(6+(o.o_orderkey*17)%30 as double) as hh
from orders o join customer c on o.o_custkey=c.c_custkey join fx_regions r on c.c_nationkey=r.region_id
""",
    "fx_files": """
select p_partkey as file_id,
  concat(lpad(cast(p_partkey%150 as {str}),3,'0'),'_ЛУБНО',cast(p_partkey%37 as {str}),
    case when p_partkey%3=0 then '_FINAL' else '' end) as region_folder,
  concat(case when p_partkey%2=0 then '03_' else '' end,'Лубно',cast(p_partkey%37 as {str}),'_',
    case p_partkey%10 when 0 then 'Li' when 1 then 'Ae' when 2 then 'Ае' when 3 then 'SpOr' when 4 then 'Sp' when 5 then 'Or'
      when 6 then 'MagGr' when 7 then 'GeoGr' when 8 then 'SрOr' else 'Lidar' end,
    case when p_partkey%2=0 then case p_partkey%8 when 0 then '_g' when 2 then '_c' when 4 then '_ch' else '' end
      else case p_partkey%16 when 1 then '_курганы_целые' when 3 then '_курганы_поврежденные' when 5 then '_городище' when 7 then '_фортификации'
        when 9 then '_архитектуры' when 11 then '_границы' when 13 then '_FindsPoints' else '_городища' end end) as stem,
  case when p_partkey%2=0 then case when p_partkey%6=0 then 'tiff' else 'tif' end else 'geojson' end as ext
from part
""",
    "fx_tree": """
select file_id, concat(lpad(cast(region_no as {str}),3,'0'),'_ЛУБНО',cast(region_no as {str})) as region_folder,
  case k when 0 then null when 1 then case when region_no%4=2 then '07_прочее' else '07_Разметка' end when 2 then case when region_no%5=4 then '01_карты' else '01_Li_карты' end
    when 3 then case when region_no%5=4 then '02_фото' else '02_Ae' end when 4 then case when region_no%5=4 then '03_фото' else '03_SрOr' end when 5 then '04_прочее'
    else case when region_no%4=2 then '08_прочее' else '08_разметка_li' end end as sub_folder,
  case when k=0 then case when region_no%4=1 then 'README' else 'UTM' end else concat('file_',cast(file_id as {str})) end as stem,
  case when k=0 then 'json' when k in (1,6) then 'geojson' when file_id%3=0 then 'tiff' else 'tif' end as ext
from (select p_partkey as file_id, p_partkey%20 as region_no, cast(floor(p_partkey/20) as int)%7 as k from part) t
""",
    "fx_samples": """
select object_id as sample_id, region, modality, class_name,
  case class_name when 'kurgany_tselye' then 'whole' when 'kurgany_povrezhdennye' then 'damaged' else 'unknown' end as kurgan_type,
  256+2*((object_id*37)%1500) as crop_size, 1+(object_id*13)%60 as n_objects_in_patch,
  case when object_id%6=0 then true else false end as touches_border, shifted as used_crs_fallback,
  case when object_id%2=0 then (object_id*11)%5000 else 0 end as mask_whole_pixels,
  case when object_id%3=0 then (object_id*7)%4000 else 0 end as mask_damaged_pixels
from fx_objects
""",
    "fx_label_text": """
select l_orderkey as image,
  concat(cast(l_linenumber%5 as {str}),' 0.',lpad(cast((l_partkey*7919)%1000000 as {str}),6,'0'),
    ' 0.',lpad(cast((l_suppkey*104729)%1000000 as {str}),6,'0'),
    case when l_linenumber%7=6 then ' 1.500000' else concat(' 0.',lpad(cast((l_partkey*31+l_suppkey)%400000 as {str}),6,'0')) end,
    case when l_partkey%23=0 then '' else concat(' 0.',lpad(cast((l_partkey*17)%300000 as {str}),6,'0')) end) as line
from lineitem
""",
    "fx_history": """
select user_id as run_id,
  row_number() over (partition by user_id order by ts, event_id) as epoch,
  value/500 as metric
from events
""",
    "fx_pixels0": """
select vec_id, label, idx, cast(e as double) as e from {exploded}
""",
    "fx_scores": """
select vec_id as sample_id, idx, vec_id%25 as region_id,
  case vec_id%3 when 0 then 'Li' when 1 then 'Ae' else 'SpOr' end as modality,
  10*e as logit1, 10*e+((idx%5)-2)*cast(0.3 as double) as logit2, 8*e-cast(0.2 as double) as logit3,
  case when (e>0 and (vec_id+idx)%7<>0) or (e<=0 and (vec_id+idx)%7=0) then 1 else 0 end as target
from fx_pixels0
""",
    "fx_mask": """
select sample_id, cast(floor(idx/8) as int) as row, idx%8 as col, gt,
  case when (idx+sample_id)%9=0 then 0 else gt end as pred
from (select vec_id as sample_id, idx,
  case when e>cast(0.02 as double) then 1+vec_id%5 when e<cast(-0.15 as double) then 1+(vec_id+2)%5 else 0 end as gt from fx_pixels0) m
""",
    "fx_blocks": """
select tile_id, band, idx,
  case when (tile_id*64+idx)%17=0 or (tile_id%7=3 and idx%3>0) then null
    when tile_id%5=1 then round((e+1)*20) else round((e+1)*200) end as v
from (select cast(floor(vec_id/4) as int) as tile_id, vec_id%2 as band, (vec_id%4)*64+idx as idx, e from fx_pixels0) b
""",
}

_EXPLODED = {
    "duckdb": "(select vec_id, label, unnest(embedding) as e, generate_subscripts(embedding,1)-1 as idx from embeddings) x",
    "spark": "(select vec_id, label, idx, e from (select vec_id, label, posexplode(embedding) as (idx, e) from embeddings)) x",
}
_BASE = "region nation customer part orders lineitem events embeddings".split()


def _names(sql: str, of: list[str] | dict[str, str]) -> list[str]:
    return [n for n in of if re.search(rf"\b{n}\b", sql)]


def _text(name: str, engine: str) -> str:
    return VIEWS[name].replace("{str}", "varchar" if engine == "duckdb" else "string").replace("{exploded}", _EXPLODED[engine])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the Parquet tables of a folder; it stays a lazy plan."""
    sql = _text(name, "spark")
    inner = {n: view(spark, sf_dir, n) for n in _names(sql, VIEWS) if n != name}
    inner |= {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in _names(sql, _BASE)}
    for n in inner:
        sql = re.sub(rf"(\bfrom|\bjoin) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **inner)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names as common table expressions in front."""
    needed: list[str] = []

    def add(text: str, own: str = "") -> None:
        for n in _names(text, VIEWS):
            if n != own and n not in needed:
                add(_text(n, "duckdb"), n)
                needed.append(n)

    add(sql)
    if not needed:
        return sql
    made = ", ".join(f"{n} as ({_text(n, 'duckdb')})" for n in needed)
    rest = sql.strip()
    return f"with {made}, {rest[5:]}" if rest.lower().startswith("with ") else f"with {made} {rest}"
