"""The queries opN_<name> of the numbered operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_texts

    return pack_texts(table(spark, sf_dir, "documents"), BPE_FILE).drop("loss_tokens")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Settings(words=2))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring

    return substring.digests(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lattice

    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import unigram

    return unigram.count_tokens(table(spark, sf_dir, "documents"), unigram.sentencepiece_vocabulary(PIECE_FILE))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid
    from .toxicity import held_out

    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", held_out(docs.doc_id).alias("held_out"))
    return langid.identify(rows, langid.fit(docs)).drop("text")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), BPE_FILE, stable=True))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text", toxicity.held_out(docs.doc_id).alias("held_out")), model).drop("text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import merkle

    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(docs.doc_id.cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(merkle.leaves(docs, changes={"n_chars": docs.n_chars + 1}, where=tampered)).proofs()


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.by_bytes(table(spark, sf_dir, "documents"), 24)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fim

    return fim.digests(table(spark, sf_dir, "documents"))


def _framed(value: str) -> str:
    return f"coalesce(strlen(cast({value} as varchar)) || ':' || cast({value} as varchar), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_framed(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _crc32(value: str) -> str:
    """CRC-32 of an ASCII string: eight shifts for each byte."""
    byte = f"list_transform(range(1, length({value}) + 1), lambda i: cast(ascii(substr({value}, i, 1)) as bigint))"
    shift = "(case when xor({0}, 0) % 2 = 1 then xor({0} // 2, 3988292384) else {0} // 2 end)"
    steps = f"list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, i: {shift.format('x')})"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {byte}), lambda c, b: {steps}), 4294967295)"


#: Nodes level by level in each tree, then in the tree over their roots; proofs are the
#: nodes beside those on the way up, and folding goes up once more from the tampered leaf.
_OP11 = f"""with recursive leaf as (select doc_id, coalesce('+' || lang, '') as tree, {_leaf("n_chars")} as leaf,
  case when {_crc32("cast(doc_id as varchar)")} % 7 = 0 then {_leaf("(n_chars + 1)")} end as claim from documents),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from leaf),
lower(tree, level, pos, n, node) as (select tree, 0, pos, n, leaf from placed
  union all select tree, level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' order by pos)) from lower where n > 1 group by tree, level, pos // 2),
roots as (select tree, node as subroot, max(level) over () as most, row_number() over (order by tree) - 1 as pos, count(*) over () as n from lower where n = 1),
upper(level, pos, n, node) as (select 0, pos, n, subroot from roots
  union all select level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' order by pos)) from upper where n > 1 group by level, pos // 2),
every as (select tree, level, pos, node from lower union all select '', 1000 + level, pos, node from upper),
way as (select p.doc_id, p.tree, p.pos as leaf_pos, l.level, p.pos // power(2, l.level)::bigint as pos from placed p join (select distinct tree, level from lower where n > 1) l using (tree)
  union all select p.doc_id, '', p.pos, 1000 + l.level, r.pos // power(2, l.level)::bigint from placed p join roots r using (tree), (select distinct level from upper where n > 1) l),
named as (select w.*, p.tree as own from way w join placed p on p.doc_id is not distinct from w.doc_id and p.pos = w.leaf_pos and (w.level >= 1000 or p.tree = w.tree)),
side as (select named.own, named.leaf_pos, named.level, named.pos % 2 as place, e.node from named left join every e on e.tree = named.tree and e.level = named.level and e.pos = xor(named.pos, 1)),
proof as (select own, leaf_pos, sha256(coalesce(string_agg(node, '' order by level), '')) as proof_sha256, list(struct_pack(place := place, node := coalesce(node, '')) order by level) as path from side group by 1, 2),
fold(tree, pos, step, path, node) as (select p.tree, p.pos, 1, coalesce(x.path, []), coalesce(p.claim, p.leaf) from placed p left join proof x on x.own = p.tree and x.leaf_pos = p.pos
  union all select tree, pos, step + 1, path, sha256(case when path[step].place = 1 then path[step].node || node else node || path[step].node end) from fold where step <= len(path))
select p.doc_id, p.leaf, r.subroot, u.node as root, coalesce(x.proof_sha256, sha256('')) as proof_sha256, f.node as folded_root, f.node = u.node as verified
from placed p join roots r using (tree) join upper u on u.n = 1 left join proof x on x.own = p.tree and x.leaf_pos = p.pos join fold f on f.tree = p.tree and f.pos = p.pos and f.step = len(f.path) + 1"""


def _group(i: int) -> str:
    return f"cast('0x' || substr(h, {8 * i + 1}, 8) as bigint)"


_OP13 = f"""with t as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
l as (select *, string_split(text, chr(10)) as parts, text = '' or ends_with(text, chr(10)) as whole from t),
c as (select *, len(parts) - whole::int as n from l),
r as (select *, {_group(0)} % (n + 1) as a, {_group(1)} % (n + 1) as b from c),
k as (select *, array_to_string(parts[1:least(a, b)], chr(10)) || case when least(a, b) between 1 and len(parts) - 1 then chr(10) else '' end as head,
  array_to_string(parts[1:greatest(a, b)], chr(10)) || case when greatest(a, b) between 1 and len(parts) - 1 then chr(10) else '' end as upto from r),
p as (select *, substr(upto, length(head) + 1) as body, substr(text, length(upto) + 1) as tail,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain' when {_group(3)} % 100 < 50 then 'spm' else 'psm' end as form from k)
select doc_id, n, form, case when form <> 'plain' then length(head) end as prefix_chars, case when form <> 'plain' then length(body) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || head || '<S>' || tail || '<M>' || body else '<S>' || tail || '<P>' || head || '<M>' || body end) as output_sha256,
  sha256(text) as restored_sha256 from p"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_embedding_near_dedup": op4_embedding_near_dedup,
        "op5_token_counts": op5_token_counts,
        "op6_license_scan": op6_license_scan,
        "op7_language_id": op7_language_id,
        "op8_bpe": op8_bpe,
        "op9_nearest_neighbours": op9_nearest_neighbours,
        "op10_toxicity": op10_toxicity,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_sharding": op12_sharding,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle_manifest": _OP11, "op13_fill_in_middle": _OP13}
