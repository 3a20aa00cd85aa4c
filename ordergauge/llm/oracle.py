"""The queries that SQL expresses, once more for DuckDB, written from the definitions."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def line_dedup() -> str:
    key = rf"translate(regexp_replace(line, '^[ \t-\r]+|[ \t-\r]+$', '', 'g'), '{UPPER}', '{LOWER}')"
    return f"""
    with docs as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
    lines as (select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from docs),
    keyed as (select *, {key} as key from lines),
    held as (select key, min(doc_id) as owner from keyed where length(key) >= 10 group by key having count(distinct doc_id) > 1),
    judged as (select k.*, h.key is not null and h.owner <> k.doc_id as dropped from keyed k left join held h using (key))
    select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
      sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not dropped), '')) as kept_sha256
    from judged group by r, doc_id"""


#: (label, base, needed part, phrase, last run needed), kept apart from the templates of the operator
LICENSES = (
    ("mit", True, 1.0, "under the mit license", False),
    ("apache-2", True, 1.0, "apache license version 2", False),
    ("cc-by-nc", True, 1.0, "cc by nc", False),
    ("agpl-3", False, 0.8, "licensed under the gnu affero general public license version 3", True),
    ("apache-2", False, 0.6, "you may not use this file except in compliance with the license you may obtain a copy of the license at", False),
    ("bsd", False, 0.6, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
    ("cc-by", False, 1.0, "licensed under cc by 4 0", False),
    ("cc-by-sa", False, 1.0, "licensed under cc by sa 4 0", False),
    ("gpl-2", False, 0.8, "licensed under the gnu general public license version 2", True),
    ("gpl-3", False, 0.8, "licensed under the gnu general public license version 3", True),
    ("isc", False, 0.6, "permission to use copy modify and or distribute this software for any purpose with or without fee", False),
    ("lgpl-3", False, 0.8, "licensed under the gnu lesser general public license version 3", True),
    ("mit", False, 1.0, "released under the mit license", False),
    ("mit", False, 0.6, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", False),
    ("mpl-2", False, 0.8, "this source code form is subject to the terms of the mozilla public license v 2 0", True),
    ("unlicense", False, 0.6, "this is free and unencumbered software released into the public domain", False),
)


def licenses(gram: int = 3, slack: int = 2) -> str:
    rows = []
    for number, (label, base, coverage, phrase, versioned) in enumerate(LICENSES):
        words = phrase.split()
        runs = len(words) - gram + 1
        rows += [
            f"({number}, '{label}', {str(base).lower()}, {coverage}::double, {runs}, {j}, '{' '.join(words[j : j + gram])}', "
            f"{str(not versioned or j == runs - 1).lower()})"
            for j in range(runs)
        ]
    return f"""
    with runs(template, label, base, coverage, runs, j, run, needed) as (values {", ".join(rows)}),
    docs as (select row_number() over () as r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words
      from documents),
    placed as (select r, unnest(words) as word, generate_subscripts(words, 1) - 1 as i from docs),
    texts as (select r, i, word || ' ' || lead(word) over text || ' ' || lead(word, 2) over text as run
      from placed window text as (partition by r order by i)),
    hits as (select t.r, t.i, p.* exclude (run) from texts t join runs p using (run)),
    stepped as (select *, lag(i - j) over (partition by r, template order by i - j, i) as before from hits),
    grouped as (select *, sum((before is null or (base and i - j <> before) or i - j - before > {slack})::int)
        over (partition by r, template order by i - j, i rows unbounded preceding) as span from stepped),
    spans as (select r, label, base, min(i) as start, count(distinct j) / runs::double as likeness
      from grouped group by r, template, label, base, coverage, runs, span having count(distinct j) / runs::double >= coverage and bool_or(needed))
    select d.doc_id, len(any_value(d.words)) as n_words, count(s.r) filter (where s.base) as n_base,
      min(s.start) filter (where s.base) as first_word, max(s.start) filter (where s.base) as last_word,
      coalesce(string_agg(distinct s.label, ',' order by s.label) filter (where s.base), '') as base_labels,
      coalesce(string_agg(distinct s.label, ',' order by s.label), '') as labels, coalesce(max(s.likeness), 0)::double as score
    from docs d left join spans s using (r) group by d.r, d.doc_id"""


def shards(shards: int = 40, seed: int = 17) -> str:
    hashed = lambda text: f"('0x' || substr(md5({text}), 1, 15))::bigint"
    return f"""
    with recursive steps(n, c, k) as (
      select range, range, 0 from range(256)
      union all select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
    crc as (select list(c order by n) as t from steps where k = 8),
    docs as (select doc_id, source, strlen(coalesce(text, '')) + 16 as size, hex(encode(coalesce(text, ''))) as bytes from documents),
    summed as (select doc_id, source, size, xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
        list_transform(regexp_extract_all(bytes, '..'), lambda x: ('0x' || x)::bigint)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) as text_crc32 from docs, crc),
    rows as (select *, source is null as no_source, coalesce(source, '') as stratum,
        {hashed(f"'{seed}:' || coalesce(doc_id::varchar, '') || ':' || size || ':' || text_crc32")} as h from summed),
    ranked as (select *, count(*) over (partition by no_source, stratum) as total,
        row_number() over (partition by no_source, stratum order by h, doc_id, size, text_crc32) - 1 as rank from rows),
    spread as (select *, (rank + {hashed(f"'{seed}:source:' || no_source || ':' || stratum")} / {float(1 << 60)!r}::double) / total
        as fraction from ranked),
    placed as (select *, row_number() over (order by fraction, no_source, stratum, rank) - 1 as place, count(*) over () as n
      from spread),
    dealt as (select *, (place * {shards} // n)::int as shard from placed)
    select doc_id, source, size, text_crc32, 'rows' as law, shard,
      place - (shard * n + {shards - 1}) // {shards} as slot, null::int as grown_shard from dealt"""


#: CTEs ``steps`` and ``crc`` (the table ``t`` of CRC-32) for ``_crc32``
CRC_TABLE = """steps(n, c, k) as (
      select range, range, 0 from range(256)
      union all select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
    crc as (select list(c order by n) as t from steps where k = 8)"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text, beside ``crc``."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
        list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))"""


def _tree(name: str, leaves: str, levels: int) -> str:
    """CTEs of the trees over ``leaves`` (tree, place, node): {name}0 to {name}<levels>, each node with its siblings."""
    runs = "partition by tree, place // 16 order by place"
    parts, below = [], leaves
    for k in range(levels + 1):
        parts.append(f"""{name}{k} as (select *, count(*) over (partition by tree) = 1 as alone,
            coalesce(string_agg(node, '') over ({runs} rows between unbounded preceding and 1 preceding), '') as left_of,
            coalesce(string_agg(node, '') over ({runs} rows between 1 following and unbounded following), '') as right_of
          from (select tree, place, node from {below}))""")
        below = f"""(select tree, place // 16 as place, case when bool_and(alone) then any_value(node)
            else sha256(string_agg(node, '' order by place)) end as node from {name}{k} group by tree, place // 16)"""
    return ",\n    ".join(parts)


def _climb(name: str, rows: str, levels: int) -> str:
    """CTEs {name}_way0 to {name}_way<levels>: ``rows`` with ``siblings`` and ``fold`` carried up the tree."""
    parts = [f"{name}_way0 as ({rows})"]
    for k in range(levels):
        parts.append(f"""{name}_way{k + 1} as (select w.* replace (
            case when n.alone then siblings else siblings || left_of || right_of end as siblings,
            case when n.alone then fold else sha256(left_of || fold || right_of) end as fold)
          from {name}_way{k} w join {name}{k} n on n.tree = w.tree and n.place = w.place // {16**k})""")
    return ",\n    ".join(parts)


def manifest(levels: int = 5) -> str:
    """For up to 16 to the ``levels`` documents in a source, and as many sources."""
    field = lambda x: f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ['doc_id', 'source', 'lang', 'n_chars', text]))})"
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    own = "select *, '' as siblings, case when tampered then changed else node end as fold from leaves"
    over = f"""select w.* exclude (tree, place), u.tree, u.place, u.node as subroot
        from s_way{levels} w join subroots u on u.name = w.tree"""
    return f"""
    with recursive {CRC_TABLE},
    docs as (select doc_id, coalesce('=' || source, '') as tree, {leaf("text")} as node, {leaf(lowered)} as changed,
        coalesce({_crc32("doc_id::varchar")} % 5 = 0, false) as tampered from documents, crc),
    leaves as (select *, row_number() over (partition by tree order by doc_id nulls first, node, changed) - 1 as place from docs),
    {_tree("s", "leaves", levels)},
    subroots as (select tree as name, '' as tree, row_number() over (order by tree) - 1 as place, node from s{levels}),
    {_tree("r", "subroots", levels)},
    {_climb("s", own, levels)},
    {_climb("r", over, levels)}
    select doc_id, w.node as leaf, subroot, r.node as root, sha256(siblings) as proof_sha256, fold as folded_root, fold = r.node as verified
    from r_way{levels} w, r{levels} r"""


def hard_negatives() -> str:
    return """
    with rows as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as v
      from embeddings where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (select a.r as anchor, a.vec_id as anchor_id, b.r, b.vec_id, a.label = b.label as same,
        list_inner_product(a.v, b.v)::bigint as score
      from rows a join rows b on a.r <> b.r and len(a.v) = len(b.v) where a.vec_id % 50 = 0),
    positives as (select anchor, anchor_id, r as positive, vec_id as positive_id, score as positive_score from scored where same
      qualify row_number() over (partition by anchor order by score desc, vec_id) <= 5),
    pairs as (select p.*, s.vec_id as negative_id, s.score as negative_score,
        row_number() over (partition by p.anchor, positive order by s.score desc, s.vec_id)::int as rank
      from positives p join scored s on s.anchor = p.anchor and not s.same
        and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
    select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from pairs where rank <= 3"""


def texts() -> dict[str, str]:
    return {
        "op1_license_scan": licenses(),
        "op4_sharding": shards(),
        "op6_line_dedup": line_dedup(),
        "op11_hard_negatives": hard_negatives(),
        "op12_merkle_manifest": manifest(),
    }
