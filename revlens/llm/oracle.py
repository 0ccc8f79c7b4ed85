"""DuckDB statements for the operators that SQL can express (tables are views)."""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
_WORDS = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

DECONTAMINATE = f"""
with items as (select item_id::varchar item, {_WORDS} ws from benchmark where item_id is not null),
sized as (select item, ws, least(13, len(ws)) n from items where len(ws) > 0),
windows as (select distinct item, n, array_to_string(ws[i:i + n - 1], ' ') g
            from (select *, unnest(range(1, len(ws) - n + 2)) i from sized)),
grams as (select distinct n, g from windows),
docs as (select doc_id, {_WORDS} ws from documents),
places as (select doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') g
           from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) p
                 from docs cross join (select distinct n from grams) where len(ws) >= n)),
hits as (select doc_id, n, p, g from places semi join grams using (n, g)),
covered as (select doc_id, count(distinct w) n_hit from (select doc_id, unnest(range(p, p + n)) w from hits) group by doc_id),
named as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items
          from (select distinct doc_id, item from hits join windows using (n, g)) group by doc_id)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated
from docs left join covered using (doc_id) left join named using (doc_id)
"""

LINE_DEDUP = f"""
with lines as (select doc_id, generate_subscripts(parts, 1) pos, unnest(parts) line
               from (select doc_id, string_split(coalesce(text, ''), chr(10)) parts from documents)),
keyed as (select doc_id, pos, line, translate(trim(line, {_BLANKS}), '{UPPER}', '{UPPER.lower()}') k from lines),
shared as (select k, min(doc_id) keeper from keyed where length(k) >= 10 group by k having min(doc_id) <> max(doc_id)),
marked as (select doc_id, pos, line, coalesce(doc_id <> keeper, false) gone from keyed left join shared using (k))
select doc_id, count(*)::bigint n_lines, (count(*) filter (gone))::bigint n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256
from marked group by doc_id
"""

MIXING = r"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
                      ('0x' || substr(md5('mix-1:' || doc_id::varchar), 1, 3))::bigint bin from documents),
sums as (select source, sum(size)::bigint source_size from sized group by source),
ordered as (select *, ([5.0, 2.0, 1.0])[((row_number() over (order by source collate "binary" nulls last) - 1) % 3 + 1)::int]::double weight from sums),
caps as (select *, 3.0::double * source_size cap, 3.0::double * source_size / weight ratio, sum(source_size) over () total from ordered),
levels as (select a.source, a.source_size, a.weight, a.cap, a.ratio,
                  (any_value(a.total) - coalesce(sum(b.cap) filter (b.ratio < a.ratio), 0))
                  / sum(b.weight) filter (b.ratio >= a.ratio) lvl
           from caps a, caps b group by all),
final as (select min(ratio) first_free, arg_min(lvl, ratio) top from levels where ratio >= lvl),
aim as (select source, source_size, case when ratio < first_free then cap else least(cap, weight * top) end target from levels, final),
epochs as (select *, least(floor(case when source_size > 0 then target / source_size else 0 end + 1e-12), 3)::bigint whole from aim),
rests as (select *, greatest(target - whole * source_size, 0) rest from epochs),
bins as (select source, bin, sum(size) words from sized group by source, bin),
filled as (select source, bin, words, coalesce(sum(words) over (partition by source order by bin rows between unbounded preceding and 1 preceding), 0) below from bins),
edges as (select source, source_size, target, whole, rest, max_by(struct_pack(b := bin, w := words, l := below), bin) e
          from filled join rests using (source) where below <= rest group by all),
parts as (select *, case when e.w > 0 then least(1.0, (rest - e.l) / e.w) else 0 end part from edges),
took as (select doc_id, size, source_size, target, whole,
                case when bin < e.b then 1.0 when bin = e.b then part else 0.0 end::double extra
         from sized join parts using (source))
select doc_id, size, source_size, target::double target, least(whole * size + round(extra * size)::bigint, 3 * size)::bigint taken,
       (whole + round(extra))::bigint copies from took
"""
