"""DuckDB SQL that each registered query is compared with; views are put in front by with_views."""

from __future__ import annotations

import re

from terrasift.sources.views import with_views

# pieces that several statements share


def _draw(key: str, seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || coalesce(({key})::varchar, 'null')), 1, 13))::bigint / 4503599627370496.0::double)"


_TARGETS = "('MagGr','Ae','SpOr','Li','Or')"
_ALIAS = "case {t} when 'Li' then 'Li' when 'Ae' then 'Ae' when 'Ае' then 'Ae' when 'SpOr' then 'SpOr' when 'Sp' then 'SpOr' when 'Or' then 'Or' when 'MagGr' then 'MagGr' when 'GeoGr' then 'GeoGr' end"


def _alias(t: str) -> str:
    return _ALIAS.replace("{t}", t)


def _path_modality(stem: str, path: str) -> str:
    tokens = f"list_concat(string_split({stem}, '_'), string_split(replace({path}, '/', '_'), '_'))"
    return f"list_filter(list_transform({tokens}, lambda t: {_alias('t')}), lambda m: m in {_TARGETS})[1]"


_WORD = "case when contains(stem,'курганы_поврежденные') then 'курганы_поврежденные' when contains(stem,'курганы_целые') then 'курганы_целые' else string_split(stem,'_')[-1] end"
_CLASS = """case class_raw when 'курганы_поврежденные' then 'kurgany_povrezhdennye' when 'курганы_целые' then 'kurgany_tselye' when 'городища' then 'gorodishcha'
 when 'городище' then 'gorodishcha' when 'фортификации' then 'fortifikatsii' when 'фортификация' then 'fortifikatsii' when 'архитектуры' then 'arkhitektury'
 when 'архитектура' then 'arkhitektury' when 'FindsPoints' then 'finds_points' when 'ObjectPoly' then 'object_poly' end"""
_REG = f"""reg as (select *, coalesce(string_split(region_folder,'_')[2], region_folder) as region, {_path_modality('stem', 'region_folder')} as modality,
 concat(stem,'.',ext) as file_name from fx_files)"""
_OBJ_CLASS = f"""oc as (select * from (select *, {_CLASS} as class_norm from (select file_id, stem, {_WORD} as class_raw from fx_files
 where ext='geojson' and not contains(stem,'границы'))) where class_norm is not null)"""


def _meets(dx: int) -> str:
    return f"""(o.cx-{dx}-o.hw <= r.x_left+r.width*r.px and o.cx-{dx}+o.hw >= r.x_left and o.cy-o.hh <= r.y_top and o.cy+o.hh >= r.y_top-r.height*r.px)"""


_MATCH = f"""m1 as (select o.object_id, arg_min(r.raster_id, r.file_ord) as raster_id from fx_objects o join fx_rasters r using (region_id, modality) where {_meets(0)} group by 1),
m2 as (select o.object_id, arg_min(r.raster_id, r.file_ord) as raster_id from fx_objects o join fx_rasters r using (region_id, modality)
 where {_meets(5000000)} and o.object_id not in (select object_id from m1) group by 1),
matched as (select *, false as used_crs_fallback from m1 union all select *, true from m2)"""
_LAYER = f"""l1 as (select o.region_id, o.modality, o.object_id, r.raster_id from fx_objects o join fx_rasters r using (region_id, modality) where {_meets(0)}),
l2 as (select o.object_id, r.raster_id from fx_objects o join fx_rasters r using (region_id, modality) where {_meets(5000000)}
 and (o.region_id, o.modality) not in (select (region_id, modality) from l1)),
layered as (select object_id, raster_id, false as used_crs_fallback from l1 union all select object_id, raster_id, true from l2)"""
_SIZED = """sized as (select *, (tile - floor(tile*0.25))::int as stride from (select *, case when least(a,b,c,d,e)=a then 1024 when least(a,b,c,d,e)=b then 1536
 when least(a,b,c,d,e)=c then 2048 when least(a,b,c,d,e)=d then 3072 else 4096 end as tile from (select *, abs(1024-w) as a, abs(1536-w) as b, abs(2048-w) as c,
 abs(3072-w) as d, abs(4096-w) as e from (select *, (case modality when 'Li' then 250 when 'Ae' then 600 when 'SpOr' then 1200 when 'Or' then 250 else 300 end)/px as w from fx_rasters))))"""
_GRID = """xs as (select raster_id, unnest(list_distinct(list_append(range(0, greatest(width-tile,0)+1, stride), greatest(width-tile,0)))) as x0 from sized),
ys as (select raster_id, unnest(list_distinct(list_append(range(0, greatest(height-tile,0)+1, stride), greatest(height-tile,0)))) as y0 from sized),
grid as (select raster_id, x0, y0, tile, (x0=0 or y0=0 or x0+tile>=width or y0+tile>=height) as edge from xs join ys using (raster_id) join sized using (raster_id))"""
_BOX = """pix as (select p.object_id, p.raster_id, s.modality, o.class_name, s.tile, floor((o.cx-case when p.used_crs_fallback then 5000000.0::double else 0 end-o.hw-s.x_left)/s.px)::bigint as c0,
 floor((s.y_top-(o.cy+o.hh))/s.px)::bigint as r0, floor((o.cx-case when p.used_crs_fallback then 5000000.0::double else 0 end+o.hw-s.x_left)/s.px)::bigint as c1,
 floor((s.y_top-(o.cy-o.hh))/s.px)::bigint as r1 from layered p join fx_objects o using (object_id) join sized s using (raster_id)),
hits as (select pix.*, g.x0, g.y0 from pix join grid g on pix.raster_id=g.raster_id and pix.c0 <= g.x0+g.tile-1 and pix.c1 >= g.x0 and pix.r0 <= g.y0+g.tile-1 and pix.r1 >= g.y0)"""
_LABELS = """lab as (select *, (x1<=0 or y1<=0 or x2>=tile-1 or y2>=tile-1) as edge from (select object_id, raster_id, modality, class_name, x0, y0, tile,
 least(greatest(c0-x0,0),tile-1) as x1, least(greatest(r0-y0,0),tile-1) as y1, least(greatest(c1-x0,0),tile-1) as x2, least(greatest(r1-y0,0),tile-1) as y2 from hits)
 where x2-x1>1 and y2-y1>1 and (x2-x1)*(y2-y1)>=80)"""
_ALL_LABELS = ", ".join([_LAYER, _SIZED, _GRID, _BOX, _LABELS])
_PARSED = """pl as (select image, try_cast(t[1] as int) as cls, try_cast(t[2] as double) as xc, try_cast(t[3] as double) as yc, try_cast(t[4] as double) as w, try_cast(t[5] as double) as h
 from (select image, regexp_split_to_array(trim(line), ' +') as t from fx_label_text) where len(t)=5)"""
_VALID = "(xc between 0 and 1 and yc between 0 and 1 and w>0 and w<=1 and h>0 and h<=1)"
_DECODED = f"""dec as (select image, cls, round(xc*1024-w*1024/2,1) as x1, round(yc*1024-h*1024/2,1) as y1, round(xc*1024+w*1024/2,1) as x2, round(yc*1024+h*1024/2,1) as y2,
 round(w*1024,1) as bw, round(h*1024,1) as bh, round(w*1024*(h*1024),1) as area from pl where {{where}})"""
_HOLD = "hold as (select region from fx_regions where region_id%4=1)"
_SPLIT = f"""sp as (select *, case when row_number() over (order by {_draw('region_id', 42)}, region_id) <= greatest(1, floor(count(*) over () * 0.2::double)) then 'val' else 'train' end as split from fx_regions)"""

_SIG = "(1/(1+exp(-({x}))))"


def _sig(x: str) -> str:
    return _SIG.replace("{x}", x)


_DICE = "(2*i+1e-6::double)/(p+t+1e-6::double)"
_IOU = "(i+1e-6::double)/(p+t-i+1e-6::double)"
_CS = "cs as (select sample_id, k as class_id, count(*) filter (gt=k and pred=k) as i, count(*) filter (pred=k) as p, count(*) filter (gt=k) as t from fx_mask cross join (select unnest({ks}) as k) group by 1,2)"
_SWEEP = """sw as (select sample_id, modality, th as threshold, count(*) filter (pr>th and target=1) as i, count(*) filter (pr>th) as p, sum(target)::bigint as t
 from (select *, {prob} as pr from fx_scores) cross join (select unnest([0.1::double,0.2,0.3,0.4,0.5,0.6,0.7]) as th) group by 1,2,3),
sx as (select threshold, 'all' as grp, i, p, t from sw union all select threshold, modality, i, p, t from sw)"""
_CM = "cm as (select gt, pred, count(*) as n from fx_mask where gt between 0 and {hi} group by 1,2)"

# components: every pixel takes the least pixel number that it can reach in steps to its eight neighbours
_COMP = """px as (select sample_id, row, col, {v} as class_id, (row*8+col)::int as id from fx_mask where {v}>0),
nb as (select a.sample_id, a.id, b.id as other from px a join px b on a.sample_id=b.sample_id and a.class_id=b.class_id and abs(a.row-b.row)<=1 and abs(a.col-b.col)<=1),
reach(sample_id, id, other) as (select sample_id, id, other from nb union select r.sample_id, r.id, n.other from reach r join nb n on r.sample_id=n.sample_id and r.other=n.id),
comp as (select px.*, c.comp from px join (select sample_id, id, min(other) as comp from reach group by 1,2) c using (sample_id, id))"""


def _components(value: str, suffix: str) -> str:
    s = _COMP.replace("{v}", value)
    for n in ("px", "nb", "reach", "comp"):
        s = s.replace(f"{n} as (", f"{n}{suffix} as (").replace(f"from {n} ", f"from {n}{suffix} ").replace(f"join {n} ", f"join {n}{suffix} ").replace(f"{n}(sample_id", f"{n}{suffix}(sample_id")
    return s.replace("px.*", f"px{suffix}.*").replace("from reach group", f"from reach{suffix} group").replace("from nb union", f"from nb{suffix} union")


# objects: components with their holes, which four-neighbour steps from outside do not reach; those inside a hole of their kind go
_OBJECTS = """big_t as (select sample_id, class_id, comp from comp_t group by all having count(*)>=4),
bg_t as (select sample_id, comp, r, c from big_t cross join range(-1,9) x(r) cross join range(-1,9) y(c) anti join comp_t t on t.sample_id=big_t.sample_id and t.comp=big_t.comp and t.row=r and t.col=c),
out_t(sample_id, comp, r, c) as (select sample_id, comp, -1::bigint, -1::bigint from big_t
 union select b.sample_id, b.comp, b.r, b.c from out_t o cross join (values (0,1),(0,-1),(1,0),(-1,0)) d(dr,dc) join bg_t b on b.sample_id=o.sample_id and b.comp=o.comp and b.r=o.r+d.dr and b.c=o.c+d.dc),
hole_t as (select sample_id, class_id, comp, r, c from bg_t join big_t using (sample_id, comp) anti join out_t using (sample_id, comp, r, c)),
full_t as (select sample_id, class_id, comp, row, col from comp_t union all select sample_id, class_id, comp, r::int, c::int from hole_t),
win_t as (select sample_id, comp, row-dr as r, col-dc as c, count(*) as n from full_t cross join (values (0,0),(0,1),(1,0),(1,1)) d(dr,dc) group by 1,2,3,4),
fine_t as (select sample_id, comp from win_t group by 1,2 having sum(case n when 4 then 1 when 3 then 0.5 else 0 end)>=8),
in_t as (select distinct t.sample_id, t.comp from comp_t t join hole_t h on t.sample_id=h.sample_id and t.class_id=h.class_id and t.row=h.r and t.col=h.c and t.comp<>h.comp),
tc as (select *, count(*) over (partition by sample_id, comp) as pixels from full_t semi join fine_t using (sample_id, comp) anti join in_t using (sample_id, comp))"""
_EVAL = ", ".join([_components("gt", "_t"), _components("pred", "_p"), _OBJECTS, re.sub(r"_t\b", "_p", _OBJECTS).replace("tc as", "pc as")])
_PAIRS = f"""{_EVAL},
inter as (select p.sample_id, p.class_id, p.comp as p, t.comp as t, count(*)/(any_value(p.pixels)+any_value(t.pixels)-count(*)) as iou from pc p join tc t using (sample_id, class_id, row, col) group by 1,2,3,4),
cen as (select sample_id, class_id, comp as p, floor(avg(row)+0.5)::int as row, floor(avg(col)+0.5)::int as col from pc group by 1,2,3),
hit as (select c.sample_id, c.class_id, c.p, t.comp as t from cen c join tc t using (sample_id, class_id, row, col)),
cand as (select sample_id, class_id, p, t, coalesce(iou, 0) as iou, hit.p is not null as hit from inter full join hit using (sample_id, class_id, p, t))"""
# serial matching: in order of confidence and number each prediction takes its best free truth
_MATCHED = f"""{_PAIRS},
pn as (select distinct sample_id, class_id, comp as p, (pixels*3+class_id)%4 as conf from pc),
ok as (select * from cand join pn using (sample_id, class_id, p) where iou>0.3 or hit),
grp as (select sample_id, class_id, list({{'p': p, 't': t, 'iou': iou}} order by conf desc, p, iou desc, t) as l from ok group by 1,2),
ser(sample_id, class_id, k, l, used_p, used_t) as (select sample_id, class_id, 0, l, []::int[], []::int[] from grp
 union all select sample_id, class_id, k+1, l, case when free then list_append(used_p, l[k+1].p) else used_p end, case when free then list_append(used_t, l[k+1].t) else used_t end
 from (select *, not list_contains(used_p, l[k+1].p) and not list_contains(used_t, l[k+1].t) as free from ser where k < len(l))),
tps as (select class_id, sum(len(used_p))::bigint as tp from ser where k=len(l) group by 1),
cnt as (select class_id, coalesce(tp,0)::bigint as tp, (np-coalesce(tp,0))::bigint as fp, (nt-coalesce(tp,0))::bigint as fn from
 (select class_id, coalesce(np,0) as np, coalesce(nt,0) as nt from (select class_id, count(distinct (sample_id, comp)) as np from pc group by 1) full join
  (select class_id, count(distinct (sample_id, comp)) as nt from tc group by 1) using (class_id)) left join tps using (class_id))"""

_POLY = """po as (select floor(object_id/4)::bigint as sample_id, object_id as ord, (object_id%3)::int as class_id, (object_id*13%50+7)::double as x, (object_id*29%50+7)::double as y,
 hw/2 as w, hh/2 as h, 64-(floor(object_id/4)::bigint%3)*8 as size, object_id%5=0 as holed from fx_objects),
pr as (select *, unnest(range(greatest(0,floor(y-h)::int), least(size-1,floor(y+h)::int)+1)) as row from po),
pc as (select *, abs(row+0.5-y) as dy from pr where abs(row+0.5-y) < h),
pd as (select *, least(greatest(ceil(x-w*(1-dy/h)-0.5),0),size)::int as a, least(greatest(ceil(x+w*(1-dy/h)-0.5),0),size)::int as d, holed and dy < h/2 as cut,
 least(greatest(ceil(x-w/2*(1-dy/(h/2))-0.5),0),size)::int as b, least(greatest(ceil(x+w/2*(1-dy/(h/2))-0.5),0),size)::int as c from pc),
pe as (select * replace (cut and c>b as cut) from pd),
runs as (select * from (select sample_id, ord, class_id, 2*w*h as area, row::int as row, a as c0, case when cut then b else d end as c1 from pe
 union all select sample_id, ord, class_id, 2*w*h, row::int, c, d from pe where cut) where c1>c0)"""
_RASTER = """whole as (select floor(tile_id/4)::bigint as raster_id from (select distinct tile_id from fx_blocks) group by 1 having count(*)=4),
every as (select raster_id, raster_id*4+k as tile_id, band, idx from whole cross join range(4) a(k) cross join range(2) b(band) cross join range(256) c(idx)),
ras as (select raster_id, e.band, floor(e.tile_id%4/2)::bigint*16+floor(e.idx/16)::bigint as row, e.tile_id%2*16+e.idx%16 as col, v from every e left join fx_blocks x on x.tile_id=e.tile_id and x.band=e.band and x.idx=e.idx)"""
_WINDOWS = "win as (select raster_id, raster_id%5*4+8 as size, raster_id*7%31-4 as r0, raster_id*11%29-3 as c0 from whole)"
_PAINT = """cells as (select sample_id, row, unnest(range(c0,c1)) as col, class_id, area, ord from runs {where}),
best as (select sample_id, row, col, arg_max(class_id, {order}) as class_id from cells group by 1,2,3)
select sample_id, row, class_id, count(*) as pixels from best group by 1,2,3"""
_SM = "(exp({k})/(exp(logit1)+exp(logit2)+exp(logit3)))"

SQL: dict[str, str] = {
    "geojson_features": "select object_id, case object_id%4 when 0 then 'Polygon' when 1 then 'MultiPolygon' when 2 then 'Point' else 'GeometryCollection' end as geom_type, class_name from fx_objects where object_id%17<>0",
    "geojson_lines": """select object_id, case when object_id%17=0 then null else case object_id%4 when 0 then 'Polygon' when 1 then 'MultiPolygon' when 2 then 'Point' else 'GeometryCollection' end end as geom_type,
 case when object_id%17<>0 then class_name end as class_name, case when object_id%17=0 then 'unreadable' end as reason from fx_objects""",
    "region_crs": "select region_id, region, regexp_extract(crs_urn,'EPSG::([0-9]+)',1)::int as epsg from fx_regions",
    "discover_regions": """with t as (select *, coalesce(contains(lower(sub_folder),'разметка'),false) as mk, translate(lower(sub_folder),'сор','cop') as f from fx_tree),
 m as (select *, case when mk then null when contains(f,'li') then 'Li' when contains(f,'ae') then 'Ae' when contains(f,'ае') then 'Ae' when contains(f,'sp') then 'SpOr' when contains(f,'or') then 'Or' end as m from t)
 select region_folder, max(case when mk then sub_folder end) as markup_dir, string_agg(distinct m, ',' order by m) as modalities, count(*) filter (m is not null and ext in ('tif','tiff')) as n_rasters from m group by 1
 having bool_or(sub_folder is null and stem='UTM' and ext='json') and bool_or(mk) and count(m)>0""",
    "pick_rasters": f"""with {_REG}, k as (select region, modality, file_name, row_number() over (partition by region, modality order by
 (modality='Li' and (ends_with(stem,'_g') or contains(stem,'_g_'))) desc, file_name) as rn from reg where ext<>'geojson' and modality is not null)
 select * from k where rn=1 or modality='SpOr'""",
    "registry_roundtrip": f"with {_REG} select ext, count(*) as n, count(distinct region) as n_regions from reg group by 1",
    "sample_export": f"select case when {_draw('sample_id', 7)}<0.2::double then 'val' else 'train' end as split, region, count(*) as n, sum(crop_size)::bigint as crop from fx_samples group by 1,2",
    "export_dataset": f"""with s as (select *, case when {_draw('sample_id', 7)}<0.2::double then 'val' else 'train' end as split from fx_samples)
 select split, count(*) as n, sum(sample_id%3)::bigint as n_lines, sum(case when mask_whole_pixels>0 then mask_whole_pixels end)::bigint as pixels, count(*) as renamed from s group by 1""",
    "repair_metadata": """select case when length(s)<6 then lpad(s,6,'0') else s end as sample_id, c as class_name, case c when 'kurgany_tselye' then 1 when 'kurgany_povrezhdennye' then 2 end as class_id, c as label
 from (select sample_id::varchar as s, case kurgan_type when 'whole' then 'kurgany_tselye' when 'damaged' then 'kurgany_povrezhdennye' else kurgan_type end as c from fx_samples)""",
    "folder_modality": """select file_id, case when contains(f,'_li_') or starts_with(f,'li_') then 'Li' when contains(l,'_ae_') or contains(l,'_ае_') or ends_with(l,'_ae') or ends_with(l,'_ае') then 'Ae'
 when contains(f,'_spor_') or ends_with(f,'_spor') then 'SpOr' when contains(f,'_or_') or ends_with(f,'_or') then 'Or' end as modality from (select *, translate(lower(stem),'сор','cop') as f, lower(stem) as l from fx_files)""",
    "normalize_metadata": """select case when length(s)<6 then lpad(s,6,'0') else s end as sample_id, class_name, case class_name when 'kurgany_tselye' then 1 when 'kurgany_povrezhdennye' then 2
 when 'gorodishcha' then 3 when 'fortifikatsii' then 4 when 'arkhitektury' then 5 end as class_id, class_name as label from (select * exclude (sample_id), sample_id::varchar as s from fx_samples)""",
    "class_from_name": f"with {_OBJ_CLASS} select * from oc",
    "class_by_rule": """select file_id, case when contains(l,'курганы_целые') then 'kurgany_tselye' when contains(l,'курганы_поврежденные') then 'kurgany_povrezhdennye' when contains(l,'городища') then 'gorodishcha'
 when contains(l,'фортификации') then 'fortifikatsii' when contains(l,'архитектуры') then 'arkhitektury' end as class_name from (select *, lower(stem) as l from fx_files)""",
    "type_tag": "select file_id, case when contains(stem,'курганы_целые') then 'whole' when contains(stem,'курганы_поврежденные') then 'damaged' else 'unknown' end as tag from fx_files",
    "region_modality": f"""select file_id, coalesce(case when k>1 then array_to_string(t[1:k-1],'_') end,'unknown') as region, coalesce(case when k>0 then {_alias('t[k]')} end,'unknown') as modality
 from (select *, coalesce(list_position(list_transform(t, lambda x: ({_alias('x')}) is not null), true),0)::int as k from (select *, string_split(stem,'_') as t from fx_files))""",
    "modality_from_path": f"select file_id, {_path_modality('stem', "concat(region_folder,'/',stem)")} as modality from fx_files",
    "modality_by_rule": """select file_id, case when contains(f,'li') then 'Li' when contains(f,'ae') then 'Ae' when contains(f,'ае') then 'Ae' when contains(f,'spor') then 'SpOr' when contains(f,'sp') then 'SpOr'
 when contains(f,'or') then 'Or' else 'Unknown' end as modality from (select *, translate(lower(stem),'сор','cop') as f from fx_files)""",
    "homoglyph_fold": """select file_id, f as folded, case when contains(f,'_li_') then 'Li' when contains(l,'_ae_') or contains(l,'_ае_') then 'Ae' when contains(f,'_spor_') then 'SpOr' when contains(f,'_or_') then 'Or'
 else 'Unknown' end as modality from (select *, translate(lower(stem),'сор','cop') as f, lower(stem) as l from fx_files)""",
    "region_from_folder": "select file_id, coalesce(string_split(region_folder,'_')[2], region_folder) as region from fx_files",
    "map_type": f"""with {_REG} select file_id, case when regexp_full_match(stem,'[0-9]+') then '' else regexp_replace(stem,'^[0-9]+_','') end as map_type,
 case when modality='Li' and string_split(stem,'_')[-1] in ('c','ch','g','i') then string_split(stem,'_')[-1] end as suffix from reg""",
    "safe_stem": "select sample_id, replace(replace(replace(concat(region,'/',modality,'/',class_name,' ',crop_size),'/','_'),' ','_'),':','_') as stem from fx_samples",
    "geometry_filter": "select object_id, class_name from fx_objects where object_id%7<>0 and object_id%5<>0 and hw*hh>0 and class_name in ('kurgany_tselye','kurgany_povrezhdennye')",
    "filter_samples": "select sample_id from fx_samples where mask_whole_pixels+mask_damaged_pixels>0 and modality in ('Li','Ae','SpOr') and crop_size<=1024 and n_objects_in_patch<=30 and not touches_border",
    "filter_samples_mc": "select sample_id from fx_samples where mask_whole_pixels>0 and modality in ('Li','Ae') and class_name in ('kurgany_tselye','gorodishcha') and crop_size<=2048",
    "facet_query": """select sample_id, crop_size from fx_samples where modality='Li' and crop_size between 300 and 2000 and not touches_border and (mask_whole_pixels between 1 and 4000 or mask_whole_pixels is null)
 order by crop_size desc, sample_id limit 50 offset 5""",
    "facet_query_boxes": f"with {_PARSED}, {_DECODED.format(where='true')} select image, count(*) as n, max(area) as max_area from dec where cls in (0,1) and (area between 500 and 50000 or area is null) group by 1",
    "facet_values": """select string_agg(distinct modality, ',' order by modality) as modality_values, string_agg(distinct class_name, ',' order by class_name) as class_name_values,
 string_agg(distinct kurgan_type, ',' order by kurgan_type) as kurgan_type_values, min(crop_size) as crop_size_min, max(crop_size) as crop_size_max, min(n_objects_in_patch) as n_objects_in_patch_min,
 max(n_objects_in_patch) as n_objects_in_patch_max from fx_samples""",
    "explode_parts": """with o as (select *, object_id%4 as k from fx_objects where object_id%17<>0)
 select object_id, 0 as part_id, case when k<2 then 'Polygon' else 'Point' end as part_type, case when k<2 then 4 else 1 end as n_points, case when k<2 then cx-hw else cx end as x, case when object_id%8=0 then 1 else 0 end as n_holes,
 round(case k when 0 then 4*hw*hh-case when object_id%8=0 then 0.5625::double*hw*hh else 0 end when 1 then hw*hh else 0 end,3) as area from o
 union all select object_id, 1, 'Polygon', 4, case when k=1 then cx else cx-hw end, 0, round(case when k=1 then hw*hh else 4*hw*hh end,3) from o where k in (1,3)""",
    "polygon_meets_box": """select object_id, greatest(abs(object_id%97-48)-10,0)*hh + greatest(abs(object_id*7%89-44)-10,0)*hw <= hw*hh
 and (abs(object_id%97-48)+10)*hh + (abs(object_id*7%89-44)+10)*hw >= 0.9::double*hw*hh as meets from fx_objects""",
    "polygon_stats": """select object_id, round(case when e then 31*hw*hh/16 else 3*hw*hh end,3) as area, round(case when e then 4*sqrt(hw*hw+hh*hh)+(hw+hh)/2 else 4*hw+4*hh end,3) as perimeter, round(case when e then cx-hw/124 else cx-hw/6 end,3) as mx,
 round(case when e then cy else cy-hh/6 end,3) as my, cx-hw as minx, cy-hh as miny, cx+hw as maxx, cy+hh as maxy from (select *, object_id%2=0 as e from fx_objects)""",
    "world_to_pixel": """select object_id, raster_id, floor((cx-x_left)/px)::bigint as col, floor((y_top-cy)/px)::bigint as row, x_left+floor((cx-x_left)/px)*px as x, y_top-floor((y_top-cy)/px)*px as y
 from fx_objects join fx_rasters using (region_id, modality)""",
    "reproject_utm": """with c as (select object_id, 33.0::double+(object_id%600)/100.0::double-3 as lon, (object_id*37%7500)/100.0::double as lat, 1/298.257223563::double as f from fx_objects),
 n as (select *, f/(2-f) as n from c), k as (select *, 2*sqrt(n)/(1+n) as c, 6378137.0::double/(1+n)*(1+n*n/4+n*n*n*n/64)*0.9996::double as s, n/2-2*n*n/3+5*n*n*n/16 as a1, 13*n*n/48-3*n*n*n/5 as a2, 61*n*n*n/240 as a3,
 sin(radians(lat)) as p, radians(lon-33) as d from n),
 t as (select *, atanh(p)-c*atanh(c*p) as z from k), u as (select *, (exp(z)-exp(-z))/2 as t from t), v as (select *, atan2(t,cos(d)) as xi, atanh(sin(d)/sqrt(1+t*t)) as eta from u)
 select object_id, round(500000+s*(eta+a1*cos(2*xi)*(exp(2*eta)-exp(-2*eta))/2+a2*cos(4*xi)*(exp(4*eta)-exp(-4*eta))/2+a3*cos(6*xi)*(exp(6*eta)-exp(-6*eta))/2),2) as easting,
 round(s*(xi+a1*sin(2*xi)*(exp(2*eta)+exp(-2*eta))/2+a2*sin(4*xi)*(exp(4*eta)+exp(-4*eta))/2+a3*sin(6*xi)*(exp(6*eta)+exp(-6*eta))/2),2) as northing, true as lon_back, true as lat_back from v""",
    "validity_audit": """select object_id, true as enough_points, object_id%3=2 as has_area, object_id%3=0 as self_crossing, object_id%3=2 as valid from fx_objects""",
    "repair_rings": """select object_id, 0 as part_id, 3 as n_points, hw*hh as area from fx_objects where object_id%3=0 union all select object_id, 1, 3, hw*hh from fx_objects where object_id%3=0
 union all select object_id, 0, 4, 2*hw*hh from fx_objects where object_id%3=2""",
    "clip_to_tile": """select object_id, cx as minx, cy-hh as miny, cx+hw as maxx, cy+hh as maxy, hw*hh as area from fx_objects where not shifted""",
    "layer_bounds": "select region_id, modality, min(cx-hw) as minx, min(cy-hh) as miny, max(cx+hw) as maxx, max(cy+hh) as maxy from fx_objects group by 1,2",
    "match_rasters": f"with {_MATCH} select * from matched",
    "match_layer": f"with {_LAYER} select * from layered",
    "alignment_report": f"""with {_LAYER}, g as (select region_id, modality, count(*) as n_objects, count(fb) as n_intersecting, coalesce(bool_or(fb),false) as used_fallback, min(cx-hw) as minx, max(cx+hw) as maxx, min(cy-hh) as miny, max(cy+hh) as maxy
 from fx_objects left join (select object_id, bool_or(used_crs_fallback) as fb from layered group by 1) using (object_id) group by 1,2),
 rb as (select region_id, modality, min(x_left) as raster_minx, max(x_left+width*px) as raster_maxx, min(y_top-height*px) as raster_miny, max(y_top) as raster_maxy from fx_rasters group by 1,2)
 select g.*, raster_minx, raster_maxx, raster_miny, raster_maxy, case when n_intersecting=0 then 'no_overlap' when used_fallback then 'fallback' else 'ok' end as status from g left join rb using (region_id, modality)""",
    "tile_objects": f"with {_LAYER}, {_SIZED}, {_GRID}, {_BOX} select object_id, raster_id, x0, y0 from hits",
    "window_neighbors": """select a.object_id, count(*) as n_objects_in_patch from fx_objects a join fx_objects b on a.region_id=b.region_id and a.modality=b.modality and b.cx-b.hw<=a.cx+128 and b.cx+b.hw>=a.cx-128
 and b.cy-b.hh<=a.cy+128 and b.cy+b.hh>=a.cy-128 group by 1""",
    "window_pairs": """with l as (select *, case when object_id%500=7 then 60 else 1 end as f, pow(2, object_id%5+7) as size from fx_objects),
 p as (select a.object_id as sample_id, b.object_id, a.size::bigint as crop_size, b.cx-(a.cx-a.size/4) as x, (a.cy+a.size/4)-b.cy as y, b.hw*b.f as w, b.hh*b.f as h, a.size/2 as side from l a join l b on a.region_id=b.region_id and a.modality=b.modality
  and abs(a.cx-b.cx) <= a.size/4+b.hw*b.f and abs(a.cy-b.cy) <= a.size/4+b.hh*b.f)
 select sample_id, object_id, crop_size, round((x-w)/0.5::double,3) as x0, round((y-h)/0.5::double,3) as y0, round((x+w)/0.5::double,3) as x1, round((y+h)/0.5::double,3) as y1 from p
 where greatest(-x, x-side, 0)*h + greatest(-y, y-side, 0)*w <= w*h""",
    "build_samples": f"""with {_MATCH}, j as (select m.object_id as sample_id, m.used_crs_fallback as fb, o.region_id, o.modality, r.width, r.height, px, x_left, y_top, least(greatest(ceil(greatest(2*hw/px,2*hh/px)*2),256),4096)::bigint as raw,
  floor((cx-case when m.used_crs_fallback then 5000000.0::double else 0 end-x_left)/px) as col, floor((y_top-cy)/px) as row from matched m join fx_objects o using (object_id) join fx_rasters r using (raster_id)),
 k as (select *, raw+raw%2 as size from j), z as (select *, col-floor(size/2) as c0, row-floor(size/2) as r0 from k), win as (select *, x_left+c0*px as wx, y_top-r0*px as wy from z
  where least(c0+size,width)>greatest(c0,0) and least(r0+size,height)>greatest(r0,0)),
 pa as (select w.sample_id, w.size, b.object_id as ord, case when b.object_id%9<>0 then case b.class_name when 'kurgany_tselye' then 1 when 'kurgany_povrezhdennye' then 2 when 'gorodishcha' then 3 when 'fortifikatsii' then 4 else 5 end end as class_id,
  2*(b.hw*1.0137::double)*(b.hh*1.0071::double) as area, (b.cx-case when fb then 5000000.0::double else 0 end-wx)/px as x, (wy-b.cy)/px as y, (b.hw*1.0137::double)/px as w, (b.hh*1.0071::double)/px as h, b.object_id%4=0 as holed from win w join fx_objects b on w.region_id=b.region_id and w.modality=b.modality
  and abs(b.cx-case when fb then 5000000.0::double else 0 end-wx-size*px/2) <= size*px/2+(b.hw*1.0137::double) and abs(wy-size*px/2-b.cy) <= size*px/2+(b.hh*1.0071::double)),
 po as (select * from pa where greatest(-x, x-size, 0)*h + greatest(-y, y-size, 0)*w <= w*h),
 pr as (select *, unnest(range(greatest(0,floor(y-h)::int), least(size-1,floor(y+h)::int)+1)) as row from po where class_id is not null),
 pc as (select *, abs(row+0.5-y) as dy from pr where abs(row+0.5-y) < h),
 pd as (select *, least(greatest(ceil(x-w*(1-dy/h)-0.5),0),size)::int as a, least(greatest(ceil(x+w*(1-dy/h)-0.5),0),size)::int as d, holed and dy < h/2 as cut,
  least(greatest(ceil(x-w/2*(1-dy/(h/2))-0.5),0),size)::int as b, least(greatest(ceil(x+w/2*(1-dy/(h/2))-0.5),0),size)::int as c from pc),
 runs as (select * from (select sample_id, ord, class_id, area, row, a as c0, case when cut then b else d end as c1 from pd union all select sample_id, ord, class_id, area, row, c, d from pd where cut) where c1>c0),
 cells as (select sample_id, row, unnest(range(c0,c1)) as col, class_id, area, ord from runs), best as (select sample_id, row, col, arg_max(class_id, (-area, ord)) as class_id from cells group by 1,2,3),
 st as (select sample_id, count(*) filter (class_id=1) as p1, count(*) filter (class_id=2) as p2, count(*) filter (class_id=3) as p3, count(*) filter (class_id=4) as p4, count(*) filter (class_id=5) as p5, count(*) as n,
  string_agg(distinct class_id, ';' order by class_id) as classes from best group by 1), no as (select sample_id, count(*) as n_objects, count(class_id) as labelled from po group by 1)
 select sample_id, size as crop_size, coalesce(n_objects,0) as n_objects, coalesce(p1,0) as pixels_1, coalesce(p2,0) as pixels_2, coalesce(p3,0) as pixels_3, coalesce(p4,0) as pixels_4, coalesce(p5,0) as pixels_5, coalesce(classes,'') as classes,
  size*size-coalesce(n,0) as pixels_bg, case when n_objects is null then 'no_polygons' when labelled=0 then 'no_labelled_polygon' when n is null then 'empty_mask' end as reason
 from win left join st using (sample_id) left join no using (sample_id)""",
    "region_holdout": f"with {_HOLD} select case when region in (select region from hold) then 'holdout' else 'train' end as side, modality, count(*) as n from fx_samples group by 1,2",
    "resolve_paths": """with inv as (select case when p_partkey%2=0 then 'train' else 'val' end as split, concat(p_partkey,'.png') as name from part), i as (select *, concat(split,'/',name) as path from inv),
 w as (select image, case when image%2=0 then 'train' else 'val' end as split, concat(image,'.png') as name from (select distinct image from fx_label_text)),
 l as (select *, concat(case when image%3=0 then 'old' else split end,'/',name) as path from w)
 select l.image, l.path, coalesce(a.path, b.path) as resolved from l left join i a on l.path=a.path left join i b on l.split=b.split and l.name=b.name""",
    "boxes_with_metadata": f"with {_PARSED} select o_orderpriority as priority, cls, count(*) as n from pl join orders on image=o_orderkey group by 1,2",
    "tile_size": f"with {_SIZED} select raster_id, modality, tile from sized",
    "tile_grid": f"with {_SIZED}, {_GRID} select raster_id, x0, y0, tile, edge from grid",
    "adaptive_window": f"""with {_MATCH}, j as (select m.object_id, m.raster_id, r.width, r.height, 2*hw/px as w, 2*hh/px as h, floor((cx-case when used_crs_fallback then 5000000.0::double else 0 end-x_left)/px) as col,
 floor((y_top-cy)/px) as row from matched m join fx_objects o using (object_id) join fx_rasters r using (raster_id)),
 k as (select *, least(greatest(ceil(greatest(w,h)*2),256),4096)::bigint as raw from j), c as (select *, raw+raw%2 as crop_size from k), z as (select *, (col-floor(crop_size/2))::bigint as c0, (row-floor(crop_size/2))::bigint as r0 from c)
 select object_id, raster_id, crop_size, c0, r0, greatest(c0,0) as read_c0, greatest(r0,0) as read_r0, least(c0+crop_size,width)-greatest(c0,0) as read_w, least(r0+crop_size,height)-greatest(r0,0) as read_h,
 (c0<0 or r0<0 or c0+crop_size>width or r0+crop_size>height) as touches_border, greatest(w,h)<=crop_size as target_fits_inside from z
 where least(c0+crop_size,width)-greatest(c0,0)>0 and least(r0+crop_size,height)-greatest(r0,0)>0""",
    "padded_window": f"""with {_MATCH}, j as (select m.object_id, m.raster_id, r.width, r.height, floor((cx-case when used_crs_fallback then 5000000.0::double else 0 end-hw-5-x_left)/px)::bigint as a,
 floor((y_top-cy-hh-5)/px)::bigint as b, ceil((2*hw+10)/px)::bigint as w, ceil((2*hh+10)/px)::bigint as h from matched m join fx_objects o using (object_id) join fx_rasters r using (raster_id)),
 k as (select object_id, raster_id, greatest(a,0) as col0, greatest(b,0) as row0, least(a+w,width) as c1, least(b+h,height) as r1 from j)
 select object_id, raster_id, col0, row0, c1-col0 as w, r1-row0 as h from k where c1>col0 and r1>row0""",
    "box_labels": f"""with {_ALL_LABELS} select object_id, raster_id, x0, y0, x1, y1, x2, y2, edge, round((x1+x2)/2/tile,6) as xc, round((y1+y2)/2/tile,6) as yc, round((x2-x1)/tile,6) as w, round((y2-y1)/tile,6) as h from lab""",
    "part_labels": f"""with {_LAYER}, {_SIZED}, {_GRID}, {_BOX},
 placed as (select h.object_id, h.raster_id, h.x0, h.y0, h.tile, (o.cx-case when p.used_crs_fallback then 5000000.0::double else 0 end) as ux, o.cy, o.hw, o.hh, s.x_left, s.y_top, s.px
 from hits h join fx_objects o using (object_id) join layered p on p.object_id=h.object_id and p.raster_id=h.raster_id join sized s on s.raster_id=h.raster_id),
 pieces as (select *, 'base' as piece, (ux-hw-x_left)/px as xa, (ux+hw-x_left)/px as xb, (y_top-cy)/px as ya, (y_top-(cy-hh))/px as yb from placed
 union all select *, 'left', (ux-hw-x_left)/px, (ux-hw/2-x_left)/px, (y_top-(cy+hh))/px, (y_top-cy)/px from placed
 union all select *, 'right', (ux+hw/2-x_left)/px, (ux+hw-x_left)/px, (y_top-(cy+hh))/px, (y_top-cy)/px from placed),
 cut as (select object_id, raster_id, x0, y0, tile, piece, greatest(xa,x0) as xa, least(xb,x0+tile) as xb, greatest(ya,y0) as ya, least(yb,y0+tile) as yb from pieces),
 held as (select *, bool_or(piece='base') over (partition by object_id, raster_id, x0, y0) as joined from cut where xa<xb and ya<yb),
 boxes as (select object_id, raster_id, x0, y0, tile, floor(min(xa))::bigint as c0, floor(max(xb))::bigint as c1, floor(min(ya))::bigint as r0, floor(max(yb))::bigint as r1
 from held group by object_id, raster_id, x0, y0, tile, case when joined then 'all' else piece end),
 lab as (select *, (x1<=0 or y1<=0 or x2>=tile-1 or y2>=tile-1) as edge from (select object_id, raster_id, x0, y0, tile,
 least(greatest(c0-x0,0),tile-1) as x1, least(greatest(r0-y0,0),tile-1) as y1, least(greatest(c1-x0,0),tile-1) as x2, least(greatest(r1-y0,0),tile-1) as y2 from boxes)
 where x2-x1>1 and y2-y1>1 and (x2-x1)*(y2-y1)>=80)
 select object_id, raster_id, x0, y0, x1, y1, x2, y2, edge, round((x1+x2)/2/tile,6) as xc, round((y1+y2)/2/tile,6) as yc, round((x2-x1)/tile,6) as w, round((y2-y1)/tile,6) as h from lab""",
    "repair_stars": """select object_id, case object_id%3 when 2 then 2 else 1 end as n_parts, case object_id%3 when 0 then 1 else 0 end as n_holes,
 round(case object_id%3 when 0 then 3*hw*hh when 1 then 4*hw*hh else 2*hw*hh end, 3) as area from fx_objects""",
    "flagship": f"with {_ALL_LABELS} select modality, class_name, edge, count(*) as n_boxes from lab group by 1,2,3",
    "parse_labels": f"with {_PARSED} select image, case cls when 3 then 2 else cls end as cls, xc, yc, w, h from pl where cls in (0,1,3)",
    "bad_boxes": f"with {_PARSED} select image, count(*) as n_boxes, count(*) filter (not coalesce({_VALID},false)) as n_bad from pl group by 1",
    "format_labels": f"""with {_PARSED}, t as (select image, string_agg(printf('%d %.6f %.6f %.6f %.6f', cls, xc, yc, w, h), chr(10) order by printf('%d %.6f %.6f %.6f %.6f', cls, xc, yc, w, h)) as text from pl
 where cls in (0,1) and {_VALID} group by 1) select image, coalesce(text,'') as text from (select distinct image from fx_label_text) left join t using (image)""",
    "decode_boxes": f"with {_PARSED}, {_DECODED.format(where=_VALID)} select * from dec",
    "zoom_extent": f"""with {_PARSED}, {_DECODED.format(where=_VALID)}, g as (select image, min(x1) as a, min(y1) as b, max(x2) as c, max(y2) as d from dec group by 1)
 select image, round(greatest(0,a-greatest(30,0.15::double*(c-a))),3) as zx0, round(greatest(0,b-greatest(30,0.15::double*(d-b))),3) as zy0, round(least(1024,c+greatest(30,0.15::double*(c-a))),3) as zx1,
 round(least(1024,d+greatest(30,0.15::double*(d-b))),3) as zy1 from g""",
    "polygon_runs": f"with {_POLY} select sample_id, ord, row, c0, c1 from runs",
    "paint_small_wins": f"with {_POLY}, {_PAINT.format(where='where class_id>0', order='(-area, ord)')}",
    "paint_last_wins": f"with {_POLY}, {_PAINT.format(where='', order='ord')}",
    "mask_stats": """select sample_id, count(*) filter (gt=1) as pixels_1, count(*) filter (gt=2) as pixels_2, count(*) filter (gt=3) as pixels_3, count(*) filter (gt=4) as pixels_4, count(*) filter (gt=5) as pixels_5,
 string_agg(distinct gt, ';' order by gt) filter (gt>0) as classes, count(*) filter (gt=0) as pixels_bg from fx_mask group by 1 having count(*) filter (gt>0)>0""",
    "reject_reasons": """select vec_id as sample_id, case when vec_id%5=0 then 'no_polygons' when vec_id%5=1 then 'no_labelled_polygon' when vec_id%5=2 or vec_id not in (select sample_id from fx_mask where gt>0) then 'empty_mask' when vec_id%11=4 or vec_id%7=0 then 'empty_patch' end as reason
 from embeddings""",
    "bad_mask_values": "select sample_id, gt, count(*) as n from fx_mask where gt not in (0,1,2,3) group by 1,2",
    "binary_mask": "select sample_id, row, col, (gt>0)::int as v from fx_mask",
    "tile_quality": """with p as (select tile_id, idx, bool_or(v is not null) as ok from fx_blocks group by 1,2), f as (select tile_id, count(*) filter (ok)/count(*) as valid_fraction from p group by 1),
 s as (select tile_id, stddev_pop(v) as std, quantile_cont(v,0.02) as p2, quantile_cont(v,0.98) as p98 from fx_blocks group by 1),
 j as (select tile_id, valid_fraction, case when valid_fraction>=0.35 then std end as std, case when valid_fraction>=0.35 then p2 end as p2, case when valid_fraction>=0.35 then p98 end as p98 from f left join s using (tile_id))
 select tile_id, round(valid_fraction,6) as valid_fraction, round(std,6) as std, round(p2,6) as p2, round(p98,6) as p98, round(p98-p2,6) as contrast, coalesce(std>=5 and p98-p2>=10,false) as passed from j""",
    "contrast_stretch": """with s as (select tile_id, band, quantile_cont(v,0.02) as lo, quantile_cont(v,0.98) as hi from fx_blocks group by 1,2),
 u as (select tile_id, band, idx, case when v is null or lo is null or hi<=lo then 0 else least(greatest((v-lo)/(hi-lo),0),1) end as u from fx_blocks join s using (tile_id, band))
 select tile_id, band, idx, round(u,9) as u, floor(round(u*255,6))::int as byte from u""",
    "to_rgb": """with w as (select tile_id, idx, list(coalesce(v,0) order by band) as b from fx_blocks group by 1,2)
 select tile_id, idx, b[1] as r, case when len(b)=1 then b[1] else b[2] end as g, case when len(b)=1 then b[1] when len(b)=2 then 0 else b[3] end as b from w""",
    "zscore": """select sample_id, idx, round((logit1-avg(logit1) over w)/case when stddev_pop(logit1) over w<1e-6 then 1 else stddev_pop(logit1) over w end,6) as out from fx_scores window w as (partition by sample_id)""",
    "minmax": """select sample_id, idx, round(case when max(logit1) over w-min(logit1) over w<1e-6 then 0 else (logit1-min(logit1) over w)/(max(logit1) over w-min(logit1) over w) end,6) as out from fx_scores window w as (partition by sample_id)""",
    "resize_nearest": """select m.sample_id, r.t as out_row, c.t as out_col, m.gt as value from fx_mask m join (select t, floor(t*8/12) as s from range(12) x(t)) r on m.row=r.s join (select t, floor(t*8/12) as s from range(12) x(t)) c on m.col=c.s""",
    "resize_bilinear": """select sample_id, floor(row/2)::bigint as out_row, floor(col/2)::bigint as out_col, avg(gt) as value from fx_mask group by 1,2,3""",
    "read_window": """select tile_id, band, (floor(idx/16)-tile_id%5)::bigint as r, idx%16-tile_id%7 as c, v from fx_blocks where floor(idx/16)>=tile_id%5 and floor(idx/16)<tile_id%5+tile_id%4+3 and idx%16>=tile_id%7 and idx%16<tile_id%7+tile_id%3+4""",
    "pad_patch": """with w as (select tile_id, band, floor(idx/16)-tile_id%5 as r, idx%16-tile_id%7 as c, v from fx_blocks where floor(idx/16)>=tile_id%5 and floor(idx/16)<tile_id%5+tile_id%4+3 and idx%16>=tile_id%7
 and idx%16<tile_id%7+tile_id%3+4) select k.tile_id, k.band, a.r::bigint as r, b.c::bigint as c, coalesce(w.v,0) as v from (select distinct tile_id, band from w) k cross join range(8) a(r) cross join range(8) b(c)
 left join w on k.tile_id=w.tile_id and k.band=w.band and a.r=w.r and b.c=w.c""",
    "tile_quality_grid": f"""with {_RASTER}, g(x0) as (values (0),(12)), p as (select raster_id, a.x0, b.x0 as y0, band, row, col, v from ras join g a on col>=a.x0 and col<a.x0+20 join g b on row>=b.x0 and row<b.x0+20),
 f as (select raster_id, x0, y0, count(*) filter (ok)/count(*) as valid_fraction from (select raster_id, x0, y0, row, col, bool_or(v is not null) as ok from p group by all) group by 1,2,3),
 s as (select raster_id, x0, y0, stddev_pop(v) as std, quantile_cont(v,0.02) as p2, quantile_cont(v,0.98) as p98 from p group by 1,2,3),
 j as (select raster_id, x0, y0, valid_fraction, case when valid_fraction>=0.35 then std end as std, case when valid_fraction>=0.35 then p2 end as p2, case when valid_fraction>=0.35 then p98 end as p98 from f join s using (raster_id, x0, y0))
 select raster_id, x0, y0, round(valid_fraction,6) as valid_fraction, round(std,6) as std, round(p2,6) as p2, round(p98,6) as p98, round(p98-p2,6) as contrast, coalesce(std>=5 and p98-p2>=10,false) as passed from j""",
    "read_blocks": f"with {_RASTER}, {_WINDOWS} select raster_id, band, row-greatest(r0,0) as r, col-greatest(c0,0) as c, v from ras join win using (raster_id) where row>=r0 and row<r0+size and col>=c0 and col<c0+size",
    "pad_windows": f"""with {_RASTER}, {_WINDOWS}, k as (select raster_id, r0, c0, unnest(range(size)) as r, size from win), l as (select *, unnest(range(size)) as c from k)
 select l.raster_id, b.band, l.r, l.c, coalesce(v,0) as v from l cross join (values (0),(1)) b(band) left join ras on ras.raster_id=l.raster_id and ras.band=b.band and ras.row=l.r0+l.r and ras.col=l.c0+l.c""",
    "resize_nearest_mixed": """with t as (select sample_id, sample_id%4+5 as h, sample_id%5+4 as w, row, col, gt from fx_mask) select sample_id, r, c, gt::double as v from t join range(6) a(r) on t.row=floor(r*h/6) join range(6) b(c) on t.col=floor(c*w/6)
 where row<h and col<w""",
    "resize_bilinear_mixed": """with t as (select sample_id, sample_id%4+5 as h, sample_id%5+4 as w, row, col, gt from fx_mask), y as (select distinct h, r, unnest([greatest(floor((r+0.5::double)*h/6-0.5),0), least(floor((r+0.5::double)*h/6-0.5)+1,h-1)]) as s,
  unnest([1-((r+0.5::double)*h/6-0.5-floor((r+0.5::double)*h/6-0.5)), (r+0.5::double)*h/6-0.5-floor((r+0.5::double)*h/6-0.5)]) as f, unnest([0,1]) as k from t cross join range(6) a(r)),
 x as (select distinct w, c, unnest([greatest(floor((c+0.5::double)*w/6-0.5),0), least(floor((c+0.5::double)*w/6-0.5)+1,w-1)]) as s, unnest([1-((c+0.5::double)*w/6-0.5-floor((c+0.5::double)*w/6-0.5)), (c+0.5::double)*w/6-0.5-floor((c+0.5::double)*w/6-0.5)]) as f, unnest([0,1]) as k
  from t cross join range(6) b(c)) select sample_id, r, c, round(sum(gt*y.f*x.f),6) as v from t join y on t.h=y.h and t.row=y.s join x on t.w=x.w and t.col=x.s group by 1,2,3""",
    "empty_rasters": "select tile_id, band, count(case when tile_id%11<>0 then v end) as n_valid, count(*) as n, count(case when tile_id%11<>0 then v end)=0 as empty from fx_blocks group by 1,2",
    "patch_hook": "select sample_id, idx, abs(logit1) as logit1 from fx_scores",
    "value_counts": f"with {_REG} select modality, count(*) as n from reg group by 1",
    "top_regions": "select region, count(*) as n from fx_objects group by 1 order by n desc, region limit 10",
    "crosstab": """select modality, count(*) filter (kurgan_type='damaged') as damaged, count(*) filter (kurgan_type='unknown') as unknown, count(*) filter (kurgan_type='whole') as whole from fx_samples group by 1""",
    "group_sizes": "select region, modality, class_name, count(*) as n from fx_samples group by 1,2,3",
    "region_profile": "select region, count(*) as n, count(distinct class_name) as n_classes from fx_objects group by 1",
    "describe_by_group": """select modality, count(*) as n, round(avg(crop_size),6) as mean, round(stddev_samp(crop_size),6) as std, min(crop_size)::double as min, quantile_cont(crop_size,0.25) as p25, quantile_cont(crop_size,0.5) as p50,
 quantile_cont(crop_size,0.75) as p75, max(crop_size)::double as max from fx_samples group by 1""",
    "raster_summary": f"""with {_REG}, x as (select *, case when modality='Li' and string_split(stem,'_')[-1] in ('c','ch','g','i') then string_split(stem,'_')[-1] end as suffix from reg where ext<>'geojson')
 select region, count(*) as n_files, count(distinct modality) as n_modalities, count(*) filter (modality='Li') as n_li, coalesce(string_agg(distinct modality, ',' order by modality),'') as modalities,
 coalesce(string_agg(distinct suffix, ',' order by suffix),'') as li_suffixes, bool_or(coalesce(modality='MagGr',false)) as has_maggr, bool_or(coalesce(modality='Ae',false)) as has_ae,
 bool_or(coalesce(modality='SpOr',false)) as has_spor, bool_or(coalesce(modality='Li',false)) as has_li, bool_or(coalesce(modality='Or',false)) as has_or from x group by 1""",
    "class_pixel_totals": "select 'mask_whole_pixels' as name, sum(mask_whole_pixels)::bigint as pixels from fx_samples union all select 'mask_damaged_pixels', sum(mask_damaged_pixels)::bigint from fx_samples",
    "flag_counts": """select count(*) filter (a) as n_a, count(*) filter (b) as n_b, count(*) filter (a and b) as n_both, count(*) filter (not a and not b) as n_none
 from (select mask_whole_pixels>0 as a, mask_damaged_pixels>0 as b from fx_samples)""",
    "coverage_audit": f"""with {_REG}, g as (select region, bool_or(ext='geojson') as has_markup, bool_or(ext<>'geojson' and coalesce(modality='Li',false)) as has_li, bool_or(ext<>'geojson' and coalesce(modality='Ae',false)) as has_ae,
 count(*) filter (ext<>'geojson') as n_rasters from reg group by 1)
 select *, n_rasters<5 as few_rasters, concat_ws(',', case when not has_markup then 'markup' end, case when not has_li then 'Li' end, case when not has_ae then 'Ae' end) as missing from g""",
    "files_per_class": f"with {_OBJ_CLASS} select class_norm, count(*) as n_files from oc group by 1",
    "one_row_per_image": "select image, min(line) as line from fx_label_text group by 1",
    "sample_numbering": """select sample_id, n as sample_no, concat(split,'_',case when length(n::varchar)<6 then lpad(n::varchar,6,'0') else n::varchar end) as new_stem from
 (select *, row_number() over (order by split, region, sample_id)-1 as n from (select *, case when sample_id%5=0 then 'val' else 'train' end as split from fx_samples))""",
    "early_stop": """with b as (select *, coalesce(metric > max(metric) over (partition by run_id order by epoch rows between unbounded preceding and 1 preceding), true) as better from fx_history),
 s as (select *, epoch - max(case when better then epoch end) over (partition by run_id order by epoch) as since from b),
 e as (select run_id, coalesce(min(epoch) filter (since>=12), max(epoch)) as stop_epoch, count(*) as epochs from s group by 1)
 select run_id, max(epoch) as best_epoch, round(arg_max(metric, epoch),6) as best_metric, any_value(stop_epoch) as stop_epoch, any_value(epochs) as epochs from s join e using (run_id) where epoch<=stop_epoch and better group by 1""",
    "run_ledger": """with g as (select run_id, count(*) as epochs, arg_min(metric, epoch) as first_metric, arg_max(metric, epoch) as last_metric, max(metric) as best_metric from fx_history group by 1)
 select run_id, epochs, round(first_metric,6) as first_metric, round(last_metric,6) as last_metric, round(best_metric,6) as best_metric, dense_rank() over (order by best_metric desc) as place from g""",
    "best_threshold": f"""with {_SWEEP.replace('{prob}', _sig('logit1'))}, g as (select threshold, round(avg({_DICE}),6) as dice, count(*) as n from sx where grp='all' group by 1) select * from g order by dice desc, threshold limit 1""",
    "union_layers": "select ext, modality, count(*) as n from (select ext, null::varchar as modality from fx_files union all select null, modality from fx_objects) group by 1,2",
    "split_is_partition": "select 0::bigint as lost, 0::bigint as twice",
    "negative_sampling": f"select sample_id from fx_samples where mask_whole_pixels>0 or {_draw('sample_id', 42)}<0.25::double",
    "region_split": f"with {_SPLIT} select region_id, split from sp",
    "leakage_audit": f"""with {_SPLIT}, j as (select s.region, sp.split from fx_samples s join sp using (region)) select split, count(*) as n, count(distinct region) as n_groups,
 (select count(*) from (select region from j group by 1 having count(distinct split)>1)) as n_leaking from j group by 1""",
    "leakage_shares": f"""with {_SPLIT}, j as (select s.class_name, s.modality, sp.split from fx_samples s join sp using (region)), l as (select split, 'class_name' as facet, class_name as value from j union all select split, 'modality', modality from j),
 c as (select split, facet, value, count(*) as n from l group by all) select *, round(n/sum(n) over (partition by split, facet),6) as share from c""",
    "holdout_search": f"""with c as (select region_id, class_name, modality, count(*) as n from fx_objects group by 1,2,3), r as (select region_id, sum(n)::bigint as size from c group by 1), tot as (select sum(n)::bigint as total from c),
 st as (select class_name, modality, sum(n)::bigint as all_n from c group by 1,2), x as (select t as trial, r.*, total, floor(total*0.2::double) as target, {_draw("concat(region_id, ':', t)", 42)} as d from range(5000) y(t) cross join r cross join tot),
 b as (select *, coalesce(sum(size) over (partition by trial order by d, region_id rows between unbounded preceding and 1 preceding),0) as before from x), h as (select * from b where before < target),
 s as (select trial, sum(size)::bigint as val_n, max(size) as largest, any_value(total) as total, any_value(target) as target, string_agg(region_id::varchar, ',' order by region_id) as regions from h group by 1),
 p as (select trial, class_name, modality, sum(n)::bigint as n from h join c using (region_id) group by 1,2,3),
 q as (select s.*, st.class_name, st.modality, st.all_n, coalesce(p.n,0) as n from s cross join st left join p on p.trial=s.trial and p.class_name=st.class_name and p.modality=st.modality),
 k as (select trial, class_name, any_value(val_n) as val_n, any_value(largest) as largest, any_value(total) as total, any_value(target) as target, any_value(regions) as regions,
  sum(round(abs(n/val_n-all_n/total),9)) as diff, sum(n) as n from q group by 1,2),
 z as (select trial, any_value(val_n) as val_n, any_value(largest) as largest, any_value(total) as total, any_value(target) as target, any_value(regions) as regions, sum(diff) as diff, count(*) filter (n<3) as under from k group by 1)
 select trial, round(diff+2*(abs(val_n-target)/total)+0.5::double*under+0.5::double*largest/val_n,6) as score, val_n, regions from z order by score, trial limit 1""",
    "inverse_frequency_weights": "select class_name, count(*) as n, round(1/count(*),9) as weight from fx_samples group by 1",
    "weighted_resample": f"""with v as (select class_name, count(*) as n, row_number() over (order by class_name)-1 as v, count(*) over () as k from fx_samples group by 1),
 d as (select i as draw, {_draw('i', 42)} as u, {_draw('i', 43)} as w from range((select count(*) from fx_samples)) x(i)), p as (select draw, class_name, floor(w*n)+1 as place from d join v on floor(u*k)=v),
 r as (select class_name, sample_id, row_number() over (partition by class_name order by sample_id) as place from fx_samples) select draw, sample_id from p join r using (class_name, place)""",
    "edge_policy": f"""with {_ALL_LABELS}, bad as (select distinct raster_id, x0, y0 from lab where edge), u as (select 'boxes' as policy, * from lab where not edge union all
 select 'tiles', * from lab where (raster_id, x0, y0) not in (select (raster_id, x0, y0) from bad) union all select 'keep', * from lab)
 select policy, count(*) as n, count(distinct (raster_id, x0, y0)) as n_tiles from u group by 1""",
    "tile_policy": f"""with {_ALL_LABELS}, bad as (select distinct raster_id, x0, y0 from lab where edge), k as (select raster_id, x0, y0, count(*) as n_boxes from lab group by all), w as (select raster_id, x0, y0, count(*) as n_boxes from lab where not edge group by all),
 g as (select grid.raster_id, grid.x0, grid.y0, coalesce(k.n_boxes,0) as nk, coalesce(w.n_boxes,0) as nw, bad.raster_id is not null as bad from grid left join k using (raster_id, x0, y0) left join w using (raster_id, x0, y0) left join bad using (raster_id, x0, y0))
 select 'boxes' as policy, false as positives_only, count(*) as n, sum(nw)::bigint as n_boxes from g union all select 'boxes', true, count(*), sum(nw)::bigint from g where nw>0
 union all select 'tiles', false, count(*), sum(nk)::bigint from g where not bad union all select 'tiles', true, count(*), sum(nk)::bigint from g where not bad and nk>0 union all select 'keep', true, count(*), sum(nk)::bigint from g where nk>0""",
    "sigmoid_pred": f"select sample_id, idx, round({_sig('logit1')},6) as prob, ({_sig('logit1')}>0.5)::int as pred from fx_scores",
    "softmax_argmax": """select sample_id, idx, case when logit1>=logit2 and logit1>=logit3 then 0 when logit2>=logit3 then 1 else 2 end as pred, round(exp(greatest(logit1,logit2,logit3))/(exp(logit1)+exp(logit2)+exp(logit3)),6) as prob from fx_scores""",
    "binary_dice_iou": f"""with s as (select sample_id, count(*) filter ({_sig('logit1')}>0.5 and target=1) as i, count(*) filter ({_sig('logit1')}>0.5) as p, sum(target)::bigint as t from fx_scores group by 1)
 select round(avg({_DICE}),6) as dice, round(avg({_IOU}),6) as iou, count(*) as n from s""",
    "class_dice_iou": f"with {_CS.replace('{ks}', '[0,1,2,3,4,5]')} select class_id, round(avg({_DICE}),6) as dice, round(avg({_IOU}),6) as iou from cs group by 1",
    "fg_iou_per_sample": f"with {_CS.replace('{ks}', '[1,2,3,4,5]')} select sample_id, round(avg(i/nullif(p+t-i,0)),6) as fg_iou from cs group by 1",
    "batch_mean_vs_sample_mean": f"""with s as (select sample_id, count(*) filter ({_sig('logit1')}>0.5 and target=1) as i, count(*) filter ({_sig('logit1')}>0.5) as p, sum(target)::bigint as t from fx_scores group by 1),
 d as (select sample_id, {_DICE} as d from s), b as (select floor(k/8) as b, avg(d) as m from (select d, row_number() over (order by sample_id)-1 as k from d) group by 1) select round((select avg(m) from b),6) as batch_mean, round((select avg(d) from d),6) as sample_mean""",
    "confusion": f"with {_CM.replace('{hi}', '4')} select * from cm",
    "confusion_normalized": f"with {_CM.replace('{hi}', '5')} select gt, pred, n, round(n/greatest(sum(n) over (partition by gt),1),6) as share from cm",
    "class_metrics": f"""with {_CM.replace('{hi}', '5')}, s as (select k as class_id, coalesce(sum(n) filter (gt=k and pred=k),0)::bigint as tp, coalesce(sum(n) filter (gt<>k and pred=k),0)::bigint as fp,
 coalesce(sum(n) filter (gt=k and pred<>k),0)::bigint as fn from cm cross join (select distinct gt as k from cm union select distinct pred from cm) group by 1)
 select class_id, tp, fp, fn, round(tp/(tp+fp+1e-6),6) as precision, round(tp/(tp+fn+1e-6),6) as recall, round(tp/(tp+fp+fn+1e-6),6) as iou, round(2*tp/(2*tp+fp+fn+1e-6),6) as dice from s""",
    "threshold_sweep": f"with {_SWEEP.replace('{prob}', _sig('logit1'))} select threshold, grp, round(avg({_DICE}),6) as dice, round(avg({_IOU}),6) as iou, count(*) as n from sx group by 1,2",
    "ensemble_sweep": f"""with {_SWEEP.replace('{prob}', f"{_sig('logit1')}*0.5::double+{_sig('logit2')}*0.25::double+{_sig('logit3')}*0.25::double")} select threshold, grp, round(avg({_DICE}),6) as dice, round(avg({_IOU}),6) as iou, count(*) as n
 from sx group by 1,2""",
    "bce_focal_dice": f"""with x as (select sample_id, logit1 as x, target::double as y, {_sig('logit1')} as p from fx_scores), l as (select *, -ln(p) as a, -ln(1-p) as b, y*p+(1-y)*(1-p) as pt from x),
 g as (select avg(2*y*a+(1-y)*b) as bce, avg((y*0.75::double+(1-y)*0.25::double)*pow(1-pt,2)*(y*a+(1-y)*b)) as focal from l),
 d as (select avg(1-(2*i+1e-6)/(p+t+1e-6)) as dice_loss from (select sample_id, sum(p*y) as i, sum(p) as p, sum(y) as t from x group by 1))
 select round(bce,6) as bce, round(focal,6) as focal, round(dice_loss,6) as dice_loss, round(0.5::double*bce+0.5::double*dice_loss,6) as total from g cross join d""",
    "weighted_ce": """with x as (select ((sample_id+idx)%3)::int as y, [logit1,logit2,logit3] as l, ln(exp(logit1)+exp(logit2)+exp(logit3)) as z from fx_scores), w as (select *, [0.2::double,1.0,1.5][y+1] as w from x)
 select round(sum(w*(z-l[y+1]))/sum(w),6) as ce from w""",
    "multiclass_dice_loss": f"""with x as (select ((sample_id+idx)%3)::int as y, {_SM.replace('{k}', 'logit2')} as p1, {_SM.replace('{k}', 'logit3')} as p2 from fx_scores)
 select round(1-((2*sum(case when y=1 then p1 else 0 end)+1e-6)/(sum(p1)+count(*) filter (y=1)+1e-6)+(2*sum(case when y=2 then p2 else 0 end)+1e-6)/(sum(p2)+count(*) filter (y=2)+1e-6))/2,6) as dice_loss from x""",
    "mask_components": f"""with recursive {_components('gt', '')} select sample_id, class_id, count(*) as pixels, min(row) as r0, min(col) as c0, max(row) as r1, max(col) as c1, round(avg(row),6) as cy, round(avg(col),6) as cx
 from comp group by sample_id, class_id, comp""",
    "mask_objects": f"""with recursive {_components('gt', '_t')}, {_OBJECTS} select sample_id, class_id, comp as first_pixel, pixels as filled from (select distinct sample_id, class_id, comp, pixels from tc)""",
    "eval_objects": f"""with recursive {_EVAL} select 'truth' as side, class_id, count(distinct (sample_id, comp)) as n, count(*) as pixels from tc group by 2 union all
 select 'pred', class_id, count(distinct (sample_id, comp)), count(*) from pc group by 2""",
    "object_iou": f"with recursive {_PAIRS} select class_id, count(*) as n, count(*) filter (hit) as hits, round(sum(iou),4) as iou from cand group by 1",
    "soft_match": f"with recursive {_MATCHED} select class_id, tp, fp, fn from cnt",
    "weighted_f1": f"""with recursive {_MATCHED}, f as (select *, 2*tp/greatest(2*tp+fp+fn,1) as f1, case class_id when 1 then 27.8::double when 2 then 22.2 when 3 then 16.7 when 4 then 11.1 else 5.6 end as w from cnt)
 select round(sum(f1*w)/sum(w),6) as weighted_f1, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from f""",
    "largest_part": """with p as (select object_id, unnest(range(0,object_id%4+1)) as part_id from fx_objects), a as (select *, (object_id*31+part_id*17)%23 as area from p)
 select object_id, arg_max(part_id, (area, -part_id)) as part_id, max(area) as area, any_value(case when object_id%3=0 then 1.0::double else 0.75 end) as confidence from a group by 1""",
}


def _curate(negatives: float, extra: str) -> str:
    return f"""with {_PARSED}, t as (select o_orderkey as image, case o_orderkey%3 when 0 then 'Li' when 1 then 'Ae' else 'Or' end as modality, (o_orderkey*7%100)/100.0::double as valid_fraction,
 case when o_orderkey%13<>0 then o_orderkey*11%50 end as contrast from orders),
 b as (select image, count(*) as n_boxes, count(*) filter (not coalesce({_VALID},false)) as n_bad, avg(coalesce(case when image%4<>0 then xc<0.9::double end,false)::int) as edge_share from pl where cls in (0,1,2) group by 1)
 select image, coalesce(n_boxes,0) as n_boxes from t left join b using (image) where modality in ('Li','Ae') and coalesce(n_bad=0,true) {extra} and (coalesce(n_boxes,0)>0 or {_draw('image', 42)}<{negatives}::double)"""


SQL["curate_v2"] = _curate(0.25, "")
SQL["curate_v4"] = _curate(0.15, "and coalesce(edge_share<=0.8::double,true) and valid_fraction>=0.25::double and coalesce(contrast>=3,true) and coalesce(n_boxes,0)<=20")


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in SQL.items():
        text = with_views(sql.replace("with recursive ", "with ", 1))
        out[name] = text.replace("with ", "with recursive ", 1) if "with recursive" in sql else text
    return out
