"""DuckDB SQL for the library's queries, written from the queries' definitions and run on the same tables."""

from __future__ import annotations

from .operators import sampling

DIM = 64
#: The smoothing kernel from the centre outwards.
KERNEL = (0.3989434693560978, 0.24197144565660072, 0.05399112742070441, 0.004431861620031266, 0.00013383062461474175)


def strip(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def words(t: str) -> str:
    return rf"list_filter(string_split_regex({strip(f'coalesce({t}, chr(32))')}, '\s+'), lambda w_: w_ <> '')"


def clean(t: str) -> str:
    t = rf"regexp_replace({t}, 'Enlarge this image.*?AP', '', 'gis')"
    t = rf"regexp_replace({t}, 'toggle caption.*?AP', '', 'gi')"
    t = rf"regexp_replace({t}, '\[.*?\]', '', 'g')"
    t = rf"regexp_replace({t}, ' +', ' ', 'g')"
    t = rf"regexp_replace({t}, '\n\n+', chr(10) || chr(10), 'g')"
    return strip(t)


def parts(split: str) -> str:
    return f"list_filter(list_transform({split}, lambda p_: {strip('p_')}), lambda q_: length(q_) > 0)"


def sents(t: str) -> str:
    return parts(rf"string_split(regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))")


def lead(t: str, n: int) -> str:
    return f"array_to_string(list_slice(list_slice({words(t)}, 1, 1024), 1, {n}), ' ')"


CLUSTERS = """clusters as (select doc_id // 5 as doc_id, string_agg('[photo] Enlarge this image x AP ' || replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) || ' toggle caption y AP [note]', '|||' order by doc_id) as text from documents group by 1)"""


def segments(source: str) -> str:
    """From ``source(doc_id, text)``: ``sent(doc_id, article, k, s, n)``, sentences numbered through each article."""
    return f"""
cleaned as (select doc_id, {clean('text')} as c from {source}),
arts as (select doc_id, unnest(a) as art, generate_subscripts(a, 1) - 1 as article from (select doc_id, {parts("string_split(c, '|||')")} as a from cleaned where length(c) > 0)),
paras as (select doc_id, article, art, unnest(p) as para, generate_subscripts(p, 1) - 1 as pi from (select *, {parts("string_split(art, chr(10) || chr(10))")} as p from arts)),
pieces as (select doc_id, article, pi, unnest(ss) as s, generate_subscripts(ss, 1) - 1 as si from (select *, {sents('para')} as ss from paras)),
sent as (select doc_id, article, row_number() over (partition by doc_id, article order by pi, si) - 1 as k, s, len({words('s')}) as n from pieces)"""


def greedy(source: str, top: int = 256, least: int = 64) -> str:
    """From ``sent``: ``chunk(doc_id, chunk_id, article, text, ss, token_count, sentence_count, start, "end")``."""
    return f"""{segments(source)},
lists as (select doc_id, article, list(s order by k) as ss, list(n order by k) as ns from sent group by all),
folded as (select *, list_reduce(list_transform(ns, lambda n_, i_: {{'i': i_ - 1, 'n': n_, 'cur': 0::bigint, 'at': []::bigint[]}}), lambda z, x:
  case when z.cur + x.n > {top} and (z.cur >= {least} or len(z.at) = 1) and x.i > z.at[-1] then {{'i': x.i, 'n': x.n, 'cur': x.n::bigint, 'at': list_append(z.at, x.i::bigint)}}
  else {{'i': x.i, 'n': x.n, 'cur': z.cur + x.n, 'at': z.at}} end, {{'i': 0::bigint, 'n': 0::bigint, 'cur': 0::bigint, 'at': [0]::bigint[]}}).at as cuts from lists),
cut as (select doc_id, article, ss, ns, unnest(cuts) as a, unnest(list_append(list_slice(cuts, 2, len(cuts)), len(ss))) as b from folded),
chunk as (select doc_id, row_number() over (partition by doc_id order by article, a) - 1 as chunk_id, article, array_to_string(ss[a + 1:b], ' ') as text, ss[a + 1:b] as ss, list_sum(ns[a + 1:b])::bigint as token_count, b - a as sentence_count,
  sum(list_sum(ns[a + 1:b])) over w - list_sum(ns[a + 1:b]) as start, sum(list_sum(ns[a + 1:b])) over w as "end" from cut window w as (partition by doc_id order by article, a))"""


def overlapping(source: str, target: int, top: int = 256) -> str:
    """The chunks that carry a tail over: ``ochunk(doc_id, chunk_id, article, text, token_count, sentence_count, has_overlap, overlap_tokens)``.

    One recursive step for each sentence; ``back(e, s)`` walks from e towards s over the token counts.
    """
    back = lambda s, e: f"""list_reduce(list_transform(range({e} - 1, {s} - 1, -1), lambda j_: {{'j': j_, 'k': 0::bigint, 'cur': 0::bigint, 'go': true}}), lambda w, x:
      case when not w.go or (w.k < {e} and w.cur + ns[x.j + 1] > 1.5 * {target}) then {{'j': x.j, 'k': w.k, 'cur': w.cur, 'go': false}}
      else {{'j': x.j, 'k': x.j, 'cur': w.cur + ns[x.j + 1], 'go': w.cur + ns[x.j + 1] < 0.8 * {target}}} end, {{'j': 0::bigint, 'k': ({e})::bigint, 'cur': 0::bigint, 'go': true}})"""  # noqa: E731
    return f"""{segments(source)},
lists as (select doc_id, list(article order by article, k) as aa, list(s order by article, k) as ss, list(n order by article, k) as ns from sent group by 1),
run as (
  select doc_id, aa, ss, ns, 1::bigint as i, 0::bigint as s, ns[1]::bigint as cur, 0::bigint as tail, []::struct(s bigint, e bigint, o bigint)[] as outs from lists
  union all
  select doc_id, aa, ss, ns, i + 1, case when cutting then case when again then v.k else w.k end else s end, case when cutting then case when again then v.cur else w.cur end + ns[i + 1] else cur + ns[i + 1] end,
    case when cutting then case when again then i - v.k else i - w.k end else tail end,
    case when cutting then case when again then list_concat(outs, [{{'s': s, 'e': i, 'o': tail}}, {{'s': w.k, 'e': i, 'o': i - w.k}}]) else list_append(outs, {{'s': s, 'e': i, 'o': tail}}) end else outs end
  from (select *, cutting and new and w.cur + ns[i + 1] > {top} as again, {back('w.k', 'i')} as v
    from (select *, aa[i + 1] <> aa[i] as new, cur + ns[i + 1] > {top} or aa[i + 1] <> aa[i] as cutting, {back('s', 'i')} as w from run where i < len(ns)))
),
ended as (select doc_id, aa, ss, ns, list_append(outs, {{'s': s, 'e': i, 'o': tail}}) as outs from run where i = len(ns)),
oparts as (select doc_id, aa, ss, ns, unnest(outs) as r, generate_subscripts(outs, 1) - 1 as chunk_id from ended),
ochunk as (select doc_id, chunk_id, aa[r.e] as article, array_to_string(ss[r.s + 1:r.e], ' ') as text, list_sum(ns[r.s + 1:r.e])::bigint as token_count, r.e - r.s as sentence_count, chunk_id > 0 as has_overlap,
  coalesce(list_sum(ns[r.s + 1:r.s + r.o]), 0)::bigint as overlap_tokens from oparts)"""


def vectors(source: str, keys: str) -> str:
    """``vec(keys, s, v)``: each sentence's summed token vectors, from ``source(keys, s)``."""
    cols = ", ".join(f"embedding[{i}]::double as e{i}" for i in range(1, DIM + 1))
    sums = ", ".join(f"sum(e{i})" for i in range(1, DIM + 1))
    return f"""wide as materialized (select vec_id, {cols} from embeddings), size_ as (select count(*) as n_ from embeddings),
dist as (select distinct s from {source}), toks as (select s, unnest({words('s')}) as tok from dist),
keyed_ as materialized (select s, ('0x' || substr(md5(tok), 1, 8))::bigint % n_ as vec_id from toks, size_),
vecs as materialized (select s, [{sums}] as v from keyed_ join wide using (vec_id) group by s),
vec as (select {keys}, x.s, v from {source} x join vecs using (s))"""


DOC_SENTS = f"{segments('documents')}, ds as (select doc_id, row_number() over (partition by doc_id order by article, k) - 1 as pos, s, n from sent)"
CHUNK_SENTS = f"{greedy('documents')}, cs as (select doc_id, chunk_id, unnest(ss) as s, generate_subscripts(ss, 1) - 1 as pos from chunk)"
LOW = "list_distinct(list_transform({}, lambda y_: lower(y_)))"

JACCARD = f"""jtok as (select doc_id, pos, {words('s')} as t, lead({words('s')}) over (partition by doc_id order by pos) as t2 from ds),
jac as (select doc_id, pos, case when len(t) = 0 or len(t2) = 0 then 0.0 else len(list_intersect({LOW.format('t')}, {LOW.format('t2')}))::double / len(list_distinct(list_concat({LOW.format('t')}, {LOW.format('t2')}))) end as jaccard from jtok where t2 is not null),
jnorm as (select *, case when max(jaccard) over (partition by doc_id) > 0 then jaccard / max(jaccard) over (partition by doc_id) else 0.0 end as jaccard_norm from jac)"""
HYBRID = f"""{DOC_SENTS}, {vectors('ds', 'doc_id, pos, n')}, {JACCARD},
cosr as (select doc_id, pos, n, list_cosine_similarity(v, lead(v) over (partition by doc_id order by pos)) as c from vec),
hyb as (select doc_id, pos, n, coalesce(c, 0) as c, jaccard_norm, round(0.7 * coalesce(c, 0) + (1 - 0.7) * jaccard_norm, 9) as hybrid from cosr join jnorm using (doc_id, pos))"""


def smoothing(value: str, key: str, source: str, out: str) -> str:
    terms = " + ".join(f"{KERNEL[abs(o)]!r} * h[case when i + {o} < 1 then 1 - i - ({o}) when i + {o} > nn then 2 * nn + 1 - i - ({o}) else i + {o} end]" for o in range(-4, 5))
    return f"""{out}_l as (select *, row_number() over (partition by {key} order by pos) as i, count(*) over (partition by {key}) as nn, list({value}) over (partition by {key} order by pos rows between unbounded preceding and unbounded following) as h from {source}),
{out} as (select * exclude (i, nn, h), case when nn > 4 then {terms} else {value} end as smoothed from {out}_l)"""


def candidates(key: str, source: str) -> str:
    return f"""cum_ as (select *, sum(n) over (partition by {key} order by pos) as cum, sum(n) over (partition by {key}) as total from {source}),
valid as (select *, count(*) over (partition by {key}) as kk, smoothed < lag(smoothed) over w and smoothed < lead(smoothed) over w as dip from cum_ where cum >= 64 window w as (partition by {key} order by pos)),
scored as (select *, case when coalesce(dip, false) and kk >= 3 then smoothed + 0.3 * (total - cum) / total end as sc from valid),
cand as (select {key}, coalesce(min(case when sc is not null then {{'a': sc, 'pos': pos, 'cum': cum}} end), min({{'a': smoothed, 'pos': pos, 'cum': cum}})) as b from scored group by {key})"""


_TOK = words("text")
SYSTEMS = f"""base as (select doc_id, text, {_TOK} as t from documents),
sys as (
  select 'lead64' as model, doc_id, text as document, array_to_string(t, ' ') as reference, array_to_string(t[1:64], ' ') as summary from base
  union all select 'lead128', doc_id, text, array_to_string(t, ' '), array_to_string(t[1:128], ' ') from base where len(t) > 64
  union all select 'tail64', doc_id, text, array_to_string(t, ' '), array_to_string(t[greatest(1, len(t) - 63):len(t)], ' ') from base where right(t[len(t)], 1) in ('.', '!', '?')
  union all select 'every2nd', doc_id, text, array_to_string(t, ' '), array_to_string(list_filter(t, lambda x, i: i % 2 = 1)[1:64], ' ') from base where len(t) >= 128)"""


def score_words(t: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({t}, '')), '[^a-z0-9]+'), lambda w_: w_ <> '')"


def rouge(n: int, source: str, keys: str, cand: str = "summary", ref: str = "reference") -> str:
    g = lambda t: t if n == 1 else f"list_transform(range(1, greatest(len({t}) - {n - 1}, 0) + 1), lambda i_: array_to_string({t}[i_:i_ + {n - 1}], ' '))"
    return f"""rt as (select {keys}, {score_words(cand)} as c, {score_words(ref)} as r from {source}),
rg as (select {keys}, unnest({g('c')}) as g, 1 as c, 0 as r from rt union all select {keys}, unnest({g('r')}), 0, 1 from rt),
rc as (select {keys}, g, sum(c) as c, sum(r) as r from rg group by all),
rh as (select {keys}, sum(least(c, r)) as hit, sum(c) as nc, sum(r) as nr from rc group by all),
rp as (select {keys}, coalesce(hit / nullif(nc, 0), 0)::double as p, coalesce(hit / nullif(nr, 0), 0)::double as q from rh),
rouge as (select {keys}, coalesce(p, 0) as precision, coalesce(q, 0) as recall, coalesce(2 * p * q / nullif(p + q, 0), 0) as f from {source} left join rp using ({keys}))"""


SCORES = f"""{SYSTEMS}, {rouge(1, 'sys', 'model, doc_id')},
scores as (select doc_id, model, 'precision' as metric, precision as value from rouge union all select doc_id, model, 'recall', recall from rouge union all select doc_id, model, 'f', f from rouge)"""
STATS = """count(*) as num_chunks, sum(token_count) as total_tokens, sum(overlap_tokens) as overlap_total, sum(token_count) - sum(overlap_tokens) as net_tokens, avg(token_count) as mean_tokens, stddev_pop(token_count) as std_tokens,
min(token_count) as min_tokens, max(token_count) as max_tokens, count(*) filter (overlap_tokens > 0) as overlapping, coalesce(avg(overlap_tokens) filter (overlap_tokens > 0), 0) as mean_overlap, avg(sentence_count) as mean_sentences, sum(sentence_count)::bigint as total_sentences, min(sentence_count) as min_sentences, max(sentence_count) as max_sentences,
(sum(token_count) - sum(overlap_tokens)) * 100.0 / sum(token_count) as efficiency"""
_R6 = lambda cols: ", ".join(f"round({c}, 6) as {c}" for c in cols.split())
MAPPED = f"""{CLUSTERS}, {greedy('clusters')},
mapped as (select doc_id, chunk_id, case when count(*) over (partition by doc_id) > 5 then {lead('text', 128)} else {lead('text', 256)} end as summary from chunk)"""


def _pack(costs: str, budget: int = 1000) -> str:
    return f"""list_reduce(list_transform({costs}, lambda c_, i_: {{'i': i_ - 1, 'n': c_, 'cur': 0::bigint, 'at': []::bigint[]}}), lambda z, x:
  case when x.i > z.at[-1] and z.cur + x.n > {budget} then {{'i': x.i, 'n': x.n, 'cur': x.n::bigint, 'at': list_append(z.at, x.i::bigint)}}
  else {{'i': x.i, 'n': x.n, 'cur': z.cur + x.n, 'at': z.at}} end, {{'i': 0::bigint, 'n': 0::bigint, 'cur': 0::bigint, 'at': [0]::bigint[]}}).at"""


def _tree() -> str:
    out = f"""with recursive {MAPPED},
level0 as (select doc_id, list(summary order by chunk_id) as texts from mapped group by 1)"""
    done = []
    for i in range(6):
        short = f"case when tok < 256 then joined else {lead('joined', 512)} end" if i else lead("joined", 512)
        out += f""",
s{i} as materialized (select doc_id, texts, array_to_string(texts, ' ') as joined, len({words("array_to_string(texts, ' ')")}) + 1 as tok from level{i}),
out{i} as (select doc_id, case when tok <= 1000 then {short} else {lead('joined', 512)} end as final_summary, {i} as reduction_layers from s{i} where tok <= 1000 or len(texts) <= 1),
p{i} as (select *, {_pack(f"list_transform(texts, lambda t_: len({words('t_')}) + 1)")} as cuts from s{i} where tok > 1000 and len(texts) > 1),
level{i + 1} as materialized (select doc_id, list_transform(range(1, len(cuts) + 1), lambda k_: {lead("array_to_string(texts[cuts[k_] + 1:coalesce(cuts[k_ + 1], len(texts))], ' ')", 256)}) as texts from p{i})"""
        done.append(f"select * from out{i}")
    done.append(f"select doc_id, {lead("array_to_string(texts, ' ')", 512)}, 6 from level6")
    return f"""{out}, fin as ({' union all '.join(done)}),
head as (select doc_id, len(texts) as n_chunks, array_to_string(texts, ' ') as concatenated_intermediate from level0)
select doc_id, coalesce(n_chunks, 0) as n_chunks, coalesce(reduction_layers, 0) as reduction_layers, len({words("coalesce(final_summary, '')")}) as final_tokens, coalesce(final_summary, '') as final_summary, coalesce(concatenated_intermediate, '') as concatenated_intermediate
from clusters left join head using (doc_id) left join fin using (doc_id)"""


#: Rows of ``documents`` at the size that the oracle runs on; the seeded samples are drawn from so many positions.
ORACLE_ROWS = 1000


def _ids(ids: list[int]) -> str:
    return f"ids as (select unnest([{', '.join(map(str, ids))}]) as doc_id, unnest(range({len(ids)})) as ord)"


_SHARDS = f"{_ids(sampling.shuffled_ids(ORACLE_ROWS, ORACLE_ROWS // 2))}, shards as (select ord, doc_id, ord // 100 as shard, ord % 100 as place from ids)"
_MODES = {"fixed_overlap": 32, "no_overlap": 0, "large_tail": 64, "small_tail": 16}
_ABLATION = " union all ".join(
    f"select * from (with recursive {CLUSTERS}, {overlapping('clusters', t)}, st as (select doc_id, {STATS} from ochunk group by 1) select '{m}' as mode, count(*) as num_docs, round(avg(num_chunks), 6) as mean_chunks, round(avg(mean_tokens), 6) as mean_tokens, round(avg(std_tokens), 6) as mean_std, round(avg(overlap_total), 6) as mean_overlap_total, round(avg(efficiency), 6) as mean_efficiency from st)"
    for m, t in _MODES.items()
)
_MID = ", ".join(f"avg(v[{i}])" for i in range(1, DIM + 1))
_CENTROID = f"mid as (select doc_id, chunk_id, count(*) as n, [{_MID}] as c from vec group by all having count(*) > 2)"
_BLENDS = f"with {SYSTEMS}, {rouge(1, 'sys', 'model, doc_id')}, w as (select *, unnest(range(11)) / 10.0::double as alpha from rouge), b as (select model, doc_id, alpha, alpha * precision + (1 - alpha) * recall as blend from w)"

SQL: dict[str, str] = {
    "clean_text": f"with {CLUSTERS} select doc_id, {clean('text')} as cleaned, length({strip('text')}) = 0 as blank from clusters",
    "split_articles": f"with {CLUSTERS}, {segments('clusters')} select doc_id, article as article_idx, art as article from arts",
    "split_paragraphs": f"with {CLUSTERS}, {segments('clusters')} select doc_id, article as article_idx, pi as para_idx, para as paragraph from paras",
    "split_sentences": f"select doc_id, unnest(ss) as sentence, generate_subscripts(ss, 1) - 1 as sent_idx from (select doc_id, {sents('text')} as ss from documents where text is not null)",
    "paragraph_boundaries": f"with {CLUSTERS}, {segments('clusters')} select doc_id, article as article_idx, pi as para_idx, sum(len({sents('para')})) over (partition by doc_id, article order by pi) as boundary from paras",
    "token_counts": f"select doc_id, len({words('text')}) as tokens, len({words('text')}) + 1 as tokens_special, len({words(clean('text'))}) as doc_words from documents",
    "char_truncate": f"select doc_id, substring(coalesce(text, ''), 1, 4000) as cut, substring(text, 1, 500) || '...' as preview, case when length({strip("coalesce(text, '')")}) = 0 then 'Empty document' else text end as filled from documents",
    "token_char_truncate": f"select doc_id, substring(array_to_string({words('text')}[1:200], ' '), 1, 800) as cut, {lead('text', 128)} as generated from documents",
    "flat_chunks": f"with t as (select doc_id, {words(clean('text'))} as t from documents), w as (select doc_id, t, unnest(range(0, len(t), 1024)) as a from t) select doc_id, a // 1024 as chunk_id, array_to_string(t[a + 1:a + 1024], ' ') as text, len(t[a + 1:a + 1024]) as token_count from w",
    "flat_overlap_chunks": f"with t as (select doc_id, {words(clean('text'))} as t from documents), w as (select doc_id, t, unnest(range(0, len(t), 896)) as a from t) select doc_id, a // 896 as chunk_id, array_to_string(t[a + 1:a + 1024], ' ') as text, len(t[a + 1:a + 1024]) as token_count from w where a = 0 or a - 896 + 1024 < len(t)",
    "greedy_chunks": f"with {greedy('documents')} select * exclude (ss) from chunk",
    "cluster_greedy_chunks": f"with {CLUSTERS}, {greedy('clusters')} select * exclude (ss) from chunk",
    "overlap_chunks": f"with recursive {CLUSTERS}, {overlapping('clusters', 32)} select * from ochunk",
    "no_overlap_chunks": f"with recursive {CLUSTERS}, {overlapping('clusters', 0)} select * from ochunk",
    "export_roundtrip": f"with {greedy('documents')} select * exclude (ss), count(*) over (partition by doc_id) as num_chunks, 256 as max_tokens from chunk",
    "chunk_stats": f"with recursive {overlapping('documents', 32)}, st as (select doc_id, {STATS} from ochunk group by 1) select doc_id, coalesce(num_chunks, 0) as num_chunks, total_tokens, overlap_total, net_tokens, min_tokens, max_tokens, total_sentences, min_sentences, max_sentences, overlapping, {_R6('mean_tokens std_tokens mean_overlap mean_sentences efficiency')} from documents left join st using (doc_id)",
    "ablation_compare": _ABLATION,
    "validate_chunks": f"""with recursive {CLUSTERS}, {overlapping('clusters', 32)},
v as (select *, lead(chunk_id) over w is null as is_last, lag(token_count) over w as prev from ochunk window w as (partition by doc_id order by chunk_id))
select doc_id, chunk_id, token_count <= 256 as is_valid, coalesce(array_to_string(list_filter([case when token_count > 256 then 'over budget' end, case when token_count < 64 and not is_last then 'under minimum' end,
case when abs(len({words('text')}) - token_count) > 5 then 'count mismatch' end, case when overlap_tokens > 0.5 * least(prev, token_count) then 'excessive overlap' end], lambda m: m is not null), '; '), '') as warnings from v""",
    "jaccard_adjacent": f"with {DOC_SENTS}, {JACCARD} select doc_id, pos, round(jaccard, 6) as jaccard, round(jaccard_norm, 6) as jaccard_norm from jnorm",
    "cosine_adjacent": f"with {DOC_SENTS}, {vectors('ds', 'doc_id, pos, n')}, a as (select doc_id, pos, list_cosine_similarity(v, lead(v) over (partition by doc_id order by pos)) as cosine from vec) select doc_id, pos, round(cosine, 6) as cosine, round((cosine + 1) / 2, 6) as rescaled from a where cosine is not null",
    "hybrid_signal": f"with {HYBRID} select doc_id, pos, round(0.7 * c + (1 - 0.7) * jaccard_norm, 6) as hybrid from hyb",
    "smoothed_signal": f"with {HYBRID}, {smoothing('hybrid', 'doc_id', 'hyb', 'sm')} select doc_id, pos, round(smoothed, 6) as smoothed from sm",
    "split_candidates": f"with {HYBRID}, {smoothing('hybrid', 'doc_id', 'hyb', 'sm')}, sr as (select * replace (round(smoothed, 8) as smoothed) from sm), {candidates('doc_id', 'sr')} select doc_id, b.cum as cum_at, b.pos + 1 as split_after, round(b.a, 6) as score from cand",
    "alpha_sweep": f"with {HYBRID}, al as (select doc_id, pos, n, alpha, alpha * c + (1 - alpha) * jaccard_norm as mixed from hyb, (select unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::double[]) as alpha)), {smoothing('mixed', 'alpha, doc_id', 'al', 'sm')}, {candidates('alpha, doc_id', 'sm')} select alpha, count(*) as n_docs, round(avg(b.pos + 1), 2) as mean_split from cand group by 1",
    "similarity_matrix": f"with {CHUNK_SENTS}, {vectors('cs', 'doc_id, chunk_id, pos')} select a.doc_id, a.chunk_id, a.pos as i, b.pos as j, round((list_cosine_similarity(a.v, b.v) + 1) / 2, 6) as similarity from vec a join vec b on a.doc_id = b.doc_id and a.chunk_id = b.chunk_id and a.pos < b.pos",
    "coherence_local": f"""with {CHUNK_SENTS}, {vectors('cs', 'doc_id, chunk_id, pos')}, a as (select doc_id, chunk_id, (list_cosine_similarity(v, lead(v) over (partition by doc_id, chunk_id order by pos)) + 1) / 2 as s from vec)
select doc_id, chunk_id, count(*) as n, round(coalesce(avg(s), 1), 6) as local_coherence, round(coalesce(var_pop(s), 0), 6) as coherence_variance, round(coalesce(min(s), 1), 6) as min_coherence, round(coalesce(max(s), 1), 6) as max_coherence from a group by all""",
    "coherence_global": f"""with {CHUNK_SENTS}, {vectors('cs', 'doc_id, chunk_id, pos')}, {_CENTROID},
whole as (select doc_id, chunk_id, n, avg((list_cosine_similarity(v, c) + 1) / 2) as whole from vec join mid using (doc_id, chunk_id) group by all),
seg as (select doc_id, chunk_id, least((row_number() over (partition by doc_id, chunk_id order by pos) - 1) // (n // least(5, n // 3)), least(5, n // 3) - 1) as seg, v from vec join mid using (doc_id, chunk_id) where n > 10),
mids as (select doc_id, chunk_id, seg, [{_MID}] as c from seg group by all),
adj as (select doc_id, chunk_id, (list_cosine_similarity(c, lead(c) over (partition by doc_id, chunk_id order by seg)) + 1) / 2 as s from mids),
hier as (select doc_id, chunk_id, avg(s) as h from adj group by all)
select doc_id, chunk_id, n, round(case when h is null then whole else 0.6 * whole + 0.4 * h end, 6) as global_coherence, round(h, 6) as hierarchical_coherence from whole left join hier using (doc_id, chunk_id)""",
    "sentence_embeddings": f"with {DOC_SENTS}, {vectors('ds', 'doc_id, pos')} select s as sentence, round(v[1], 6) as first, round(list_sum(v), 6) as total from vecs",
    "map_stage": f"with {MAPPED} select * from mapped",
    "bin_pack": f"with {MAPPED}, l as (select doc_id, list(len({words('summary')}) + 1 order by chunk_id) as costs from mapped group by 1), p as (select doc_id, {_pack('costs')} as cuts from l) select doc_id, unnest(cuts) as first_item, generate_subscripts(cuts, 1) - 1 as grp from p",
    "tree_reduce": _tree(),
    "sample_shuffle": f"with {_ids(sampling.shuffled_ids(ORACLE_ROWS, ORACLE_ROWS // 4))} select ord, doc_id, lang from ids join documents using (doc_id)",
    "sample_random": f"with {_ids(sampling.sampled_ids(ORACLE_ROWS, ORACLE_ROWS // 5))} select ord, doc_id, lang from ids join documents using (doc_id)",
    "sample_choice": f"with {_ids(sampling.chosen_ids(ORACLE_ROWS, ORACLE_ROWS // 10))} select ord, doc_id, lang from ids join documents using (doc_id)",
    "sample_hash": "select doc_id, lang from documents order by md5('42/' || doc_id), doc_id limit 100",
    "shards": f"with {_SHARDS} select ord, doc_id, shard, place from shards",
    "shard_check": f"""with {_SHARDS}, per as (select shard, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from shards group by 1), tw as (select doc_id from shards group by 1 having count(distinct shard) > 1),
sh as (select shard, count(distinct doc_id) as overlap from shards join tw using (doc_id) group by 1) select shard, n, first_id, last_id, coalesce(overlap, 0) as overlap, coalesce(first_id > lag(last_id) over (order by shard), true) as in_order from per left join sh using (shard)""",
    "match_two": f"with {SYSTEMS}, tree as (select doc_id, doc_id * 2 as ord, summary from sys where model = 'lead64' union all select doc_id, doc_id * 2 + 1, summary from sys where model = 'lead128'), l as (select doc_id, max(ord) as ord_right, arg_max(summary, ord) as summary_right from tree group by 1) select s.doc_id, summary as summary_left, summary_right, ord_right from sys s join l using (doc_id) where model = 'tail64'",
    "match_all": f"with {SYSTEMS} select doc_id, a.summary as lead64, b.summary as lead128, c.summary as tail64, d.summary as every2nd from sys a join sys b using (doc_id) join sys c using (doc_id) join sys d using (doc_id) where a.model = 'lead64' and b.model = 'lead128' and c.model = 'tail64' and d.model = 'every2nd'",
    "match_report": f"""with {SYSTEMS}, l as (select doc_id as a, document as da, reference as ra from sys where model = 'lead128'), r as (select doc_id as b, document as db, reference as rb from sys where model = 'tail64'), j as (select * from l full join r on a = b)
select count(*) filter (a is not null and b is not null) as common, count(*) filter (b is null) as only_in_left, count(*) filter (a is null) as only_in_right, count(*) filter (a is not null and b is not null and da is not distinct from db) as same_document,
count(*) filter (a is not null and b is not null and ra is not distinct from rb) as same_reference, count(a) as n_left, count(b) as n_right, round(count(*) filter (a is not null and b is not null) * 100.0 / greatest(count(a), count(b)), 6) as overlap_pct from j""",
    "anti_done": f"with {SYSTEMS} select doc_id, lang from documents where doc_id not in (select doc_id from sys where model = 'every2nd')",
    "lookup_source": "select l.doc_id, quality, lang, n_chars from labels l left join documents d using (doc_id)",
    "rouge1": f"with {SYSTEMS}, {rouge(1, 'sys', 'model, doc_id')} select model, doc_id, {_R6('precision recall f')} from rouge",
    "rouge2": f"with {SYSTEMS}, {rouge(2, 'sys', 'model, doc_id')} select model, doc_id, {_R6('precision recall f')} from rouge",
    "rouge_turns": f"with t as (select conv_id, turn, role, text as reference, lead(text) over w as summary, lead(role) over w as who from conversations window w as (partition by conv_id order by turn)), p as (select * from t where role = 'user' and who = 'assistant'), {rouge(1, 'p', 'conv_id, turn')} select conv_id, turn, {_R6('precision recall f')} from rouge",
    "rouge_corpus": f"with {SYSTEMS}, {rouge(1, 'sys', 'model, doc_id')} select model, count(*) as n, round(avg(precision) * 100, 5) as precision, round(avg(recall) * 100, 5) as recall, round(avg(f) * 100, 5) as f from rouge join sys using (model, doc_id) where length({strip('summary')}) > 0 and length({strip('reference')}) > 0 group by 1",
    "score_summary": f"with {SCORES} select model, metric, count(*) as n_samples, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(median(value), 6) as median, round(min(value), 6) as min, round(max(value), 6) as max from scores group by all",
    "positive_summary": f"with {SCORES}, p as (select model, metric, value - 0.5 as value from scores) select model, metric, count(*) filter (value > 0) as n_samples, count(*) filter (not value > 0) as n_failed, round(coalesce(avg(value) filter (value > 0), 0), 6) as mean, round(coalesce(stddev_pop(value) filter (value > 0), 0), 6) as std, round(coalesce(median(value) filter (value > 0), 0), 6) as median, round(coalesce(min(value) filter (value > 0), 0), 6) as min, round(coalesce(max(value) filter (value > 0), 0), 6) as max from p group by all",
    "model_ranking": f"with {SCORES}, m as (select model, avg(value) as mean from scores where metric = 'f' group by 1) select model, round(mean, 6) as mean, row_number() over (order by round(mean, 9) desc, model) as rank from m",
    "metric_diff": f"with {SCORES}, m as (select model, metric, avg(value) as mean from scores group by all) select a.model as baseline, a.metric, round(b.mean - a.mean, 6) as difference from m a join m b on a.metric = b.metric and b.model = 'lead128' and a.model <> 'lead128'",
    "best_alpha": f"{_BLENDS}, v as (select model as metric, alpha, round(avg(blend), 6) as value from b group by all) select metric, arg_max(alpha, {{'v': value, 's': -alpha}}) as alpha, max(value) as value from v group by 1",
    "sweep_consistency": f"{_BLENDS}, r as (select * from b where model = 'lead64'), k as (select doc_id, count(distinct alpha) as c from r group by 1) select count(distinct alpha) as settings, count(distinct doc_id) as ids, case when (select min(c) from k) = count(distinct alpha) and count(*) = count(distinct alpha) * count(distinct doc_id) then 'PASSED' else 'FAILED' end as status from r",
    "wilcoxon": f"""with {SYSTEMS}, {rouge(1, 'sys', 'model, doc_id')}, p as (select b.model as baseline, round(a.f - b.f, 9) as d from rouge a join rouge b on a.doc_id = b.doc_id and a.model = 'lead128' and b.model <> 'lead128'),
q as (select baseline, d, count(*) over (partition by baseline, abs(d)) as t, rank() over (partition by baseline order by abs(d)) as k from p where d <> 0), r as (select *, k + (t - 1) / 2.0 as rk from q),
s as (select baseline, count(*) as n, sum(case when d > 0 then rk else 0 end) as w_plus, sum(case when d < 0 then rk else 0 end) as w_minus, sum(t * t - 1) as tie from r group by 1), m as (select baseline, avg(d) as mean_diff from p group by 1)
select baseline, coalesce(n, 0) as n, coalesce(w_plus, 0)::double as w_plus, coalesce(w_minus, 0)::double as w_minus, round((least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48), 6) as z, round(mean_diff, 6) as mean_diff from m left join s using (baseline)""",
    "stream_source_tokens": f"select source, count(*) as n_docs, sum(len({words('text')})) as n_tokens from documents group by 1",
}
_X = "abs(z) / sqrt(2.0)"
_T = f"(1 / (1 + 0.3275911 * {_X}))"
_P = f"((((1.061405429 * {_T} - 1.453152027) * {_T} + 1.421413741) * {_T} - 0.284496736) * {_T} + 0.254829592) * {_T} * exp(-({_X}) * ({_X}))"
SQL["wilcoxon"] = f"select *, round({_P}, 4) as p, coalesce({_P} < 0.05, false) as significant from ({SQL['wilcoxon']})"
_QUALITY = f"""quality as (select g.doc_id, g.chunk_id, g.text, g.ss, g.token_count, g.sentence_count, l.local_coherence, case when g.sentence_count > 5 then coalesce(w.global_coherence, l.local_coherence) else l.local_coherence end as global_coherence,
l.coherence_variance as variance_coherence, l.min_coherence, l.max_coherence, case when g.sentence_count > 5 then w.hierarchical_coherence end as hierarchical_coherence
from (with {greedy('documents')} select * from chunk) g left join ({SQL['coherence_local']}) l using (doc_id, chunk_id) left join ({SQL['coherence_global']}) w using (doc_id, chunk_id))"""
_GROUPS = ", ".join(f"round({f}({p}_coherence), 6) as {n}_{p}_coherence" for p in ("local", "global") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max")))
SQL |= {
    "chunk_coherence": f"with {_QUALITY} select doc_id, chunk_id, sentence_count, local_coherence, global_coherence, variance_coherence, min_coherence, max_coherence, hierarchical_coherence from quality",
    "chunk_quality_stats": f"with {_QUALITY.replace(', 6) as', ', 12) as')} select doc_id, count(*) as num_chunks, sum(sentence_count)::bigint as total_sentences, min(sentence_count) as min_sentences, max(sentence_count) as max_sentences, {_GROUPS}, round(avg(variance_coherence), 6) as mean_coherence_variance from quality group by 1",
    "validate_quality": f"""with {_QUALITY}, v as (select *, lead(chunk_id) over (partition by doc_id order by chunk_id) is null as is_last from quality)
select doc_id, chunk_id, token_count <= 256 as is_valid, coalesce(array_to_string(list_filter([case when token_count > 256 then 'over budget' end, case when token_count < 64 and not is_last then 'under minimum' end, case when abs(len({words('text')}) - token_count) > 5 then 'count mismatch' end,
case when {strip("array_to_string(ss, ' ')")} <> {strip('text')} then 'not reconstructible' end, case when local_coherence < 0.6 then 'low coherence' end], lambda m: m is not null), '; '), '') as warnings from v""",
    "overlap_runs": f"""with recursive {CLUSTERS}, {overlapping('clusters', 32)},
pr as (select doc_id, chunk_id, overlap_tokens as reported, {words('text')} as t, lag({words('text')}) over (partition by doc_id order by chunk_id) as p from ochunk),
wn as (select *, least(len(t), len(p)) as s, least(len(t), len(p), reported + 50) as w from pr where p is not null and reported > 0),
ta as (select doc_id, chunk_id, unnest(p[len(p) - w + 1:len(p)]) as tok, unnest(range(w)) as i from wn), he as (select doc_id, chunk_id, unnest(t[1:w]) as tok, unnest(range(w)) as j from wn),
eq as (select doc_id, chunk_id, i, i - j as diag from ta join he using (doc_id, chunk_id, tok) where i >= j),
isl as (select doc_id, chunk_id, diag, i - row_number() over (partition by doc_id, chunk_id, diag order by i) as k from eq), runs as (select doc_id, chunk_id, count(*) as c from isl group by doc_id, chunk_id, diag, k), best as (select doc_id, chunk_id, max(c) as found from runs group by 1, 2)
select doc_id, chunk_id, reported, coalesce(found, 0) as found, abs(coalesce(found, 0) - reported) <= greatest(20.0, 0.2 * reported) as matches, coalesce(found, 0) < 0.05 * s as too_small from wn left join best using (doc_id, chunk_id)""",
    "match_first": f"with {SYSTEMS}, tree as (select doc_id, doc_id as ord, summary from sys where model = 'lead128' and doc_id < 500) select s.doc_id, s.summary as summary_left, t.summary as summary_right, t.ord as ord_right from sys s join tree t using (doc_id) where model = 'tail64'",
    "scored_turns": f"""with t as (select conv_id, turn, role, text as r, lead(text) over w as c, lead(role) over w as who from conversations window w as (partition by conv_id order by turn)), p as (select *, coalesce(length({strip('c')}), 0) > 0 and coalesce(length({strip('r')}), 0) > 0 as full_ from t where role = 'user' and who = 'assistant')
select conv_id, turn, case when not full_ or length(c) % 7 = 0 then -10.0 else length(c) - length(r) end::double as score, case when full_ and length(c) % 7 = 0 then 'seven' end as error from p""",
    "metric_frames": f"""select model, rouge1, rouge2 from (with {SYSTEMS}, {rouge(1, 'sys', 'model, doc_id')} select model, round(avg(f), 6) as rouge1 from rouge where model <> 'tail64' group by 1) a
full join (with {SYSTEMS}, {rouge(2, 'sys', 'model, doc_id')} select model, round(avg(f), 6) as rouge2 from rouge where model <> 'lead64' group by 1) b using (model)""",
    "json_array_roundtrip": "select doc_id, quality, toxic, case when quality = 1 then 0 else 1 end as file_ord from labels where quality in (0, 1)",
    "csv_roundtrip": "select doc_id, lang, length(text) as chars, md5(text) as digest from documents where length(text) > 0",
    "checkpoint_resume": "select doc_id, n_chars, false as left_over from documents",
    "indexed_report": "select coalesce(lang, 'none') as lang, count(*) as n, sum(n_chars)::bigint as chars from documents group by 1",
}
#: Sums of integers are wider in DuckDB than the queries' type.
for _name, _cols in {"paragraph_boundaries": "boundary", "greedy_chunks": 'start "end"', "export_roundtrip": 'start "end"', "cluster_greedy_chunks": 'start "end"', "chunk_stats": "total_tokens overlap_total net_tokens", "split_candidates": "cum_at", "stream_source_tokens": "n_tokens"}.items():
    SQL[_name] = f"select * replace ({', '.join(f'{c}::bigint as {c}' for c in _cols.split())}) from ({SQL[_name]})"
