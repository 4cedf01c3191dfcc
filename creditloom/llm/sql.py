"""SQL twins (DuckDB) of the queries that SQL can express.

They follow the queries' definitions with means of their own: windows of words are compared as
word lists, ranks come from window functions, licence rules from nested replacements.
"""

from __future__ import annotations

from creditloom.llm import cleaning, licenses, mixing

_WORDS = r"list_filter(string_split_regex(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _words(text: str) -> str:
    return _WORDS.replace("{text}", text)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sentences() -> str:
    known = ", ".join(f"{_quoted(words)}: {_quoted(name)}" for name, words in licenses.SENTENCES.items())

    def of(sentence: str) -> str:
        lowered = f"regexp_replace(lower({sentence}), '{licenses.NOT_IN_WORDS}', ' ', 'g')"
        return f"known[regexp_replace({lowered}, '{licenses.EDGES}', '', 'g')]"

    sequence = "array_to_string(list_transform(ids, lambda i: '<' || i || '>'), '')"
    for licence, rule in licenses.RULES:
        pattern = "".join(f"<{name}>" for name in rule)
        sequence = f"replace({sequence}, {_quoted(pattern)}, {_quoted(f'[{licence}]')})"
    return rf"""
        WITH cut AS (
            SELECT doc_id, MAP {{{known}}} AS known, string_split(
                regexp_replace(coalesce(text, ''), '{licenses.END_OF_SENTENCE}', '\1' || chr(1), 'g'), chr(1)
            ) AS sentences FROM documents
        ), found AS (
            SELECT doc_id, list_filter(flatten(list_transform(sentences, lambda s:
                CASE WHEN {of("s")} IS NOT NULL OR NOT contains(s, chr(10)) THEN [{of("s")}]
                ELSE list_transform(string_split(s, chr(10)), lambda l: {of("l")}) END
            )), lambda i: i IS NOT NULL) AS ids FROM cut
        ), ruled AS (SELECT doc_id, ids, {sequence} AS seq FROM found)
        SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
            coalesce(array_to_string(regexp_extract_all(seq, '\[([^\]]*)\]', 1), ','), '') AS licenses,
            CAST(len(seq) - len(replace(seq, '<', '')) AS BIGINT) AS n_unmatched
        FROM ruled"""


def _line_cleaning() -> str:
    furniture = "|".join(rf"\b{phrase}\b" for phrase in cleaning.BOILERPLATE)
    return rf"""
        WITH docs AS (
            SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
                {_words("text")} AS ws FROM documents
        ), windows AS (
            SELECT rid, place, ws[place:place + {cleaning.WINDOW - 1}] AS win FROM (
                SELECT rid, ws, unnest(range(1, len(ws) - {cleaning.WINDOW - 2})) AS place FROM docs)
        ), twice AS (
            SELECT rid, place, count(*) OVER (PARTITION BY rid, win) AS n FROM windows
        ), covered AS (
            SELECT rid, count(DISTINCT place + o) AS n FROM twice, range({cleaning.WINDOW}) AS r(o)
            WHERE n > 1 GROUP BY rid
        ), lines AS (
            SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs
        ), measured AS (
            SELECT rid, line, len({_words("line")}) AS n,
                regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g') AS dense FROM lines
        ), judged AS (
            SELECT rid, line, n, (
                len(regexp_replace(dense, '[^#*$%&|<>]', '', 'g')) > {cleaning.MAX_SYMBOLS} * len(dense)
                OR len(regexp_extract_all(line, '[!?#*$%&]{{2,}}')) > {cleaning.MAX_REPEATED_MARKS} * n
                OR NOT regexp_matches(line, '\p{{L}}')
                OR (n >= {cleaning.LONG_LINE} AND NOT regexp_matches(line, '[.!?,;:…。，！？؟۔।]'))
                OR (dividers >= 2 AND 3 * dividers >= n - dividers)
                OR regexp_matches(line, '^\s*(?:https?://|www\.)\S+\s*$')
                OR (n <= {cleaning.SHORT_LINE} AND regexp_matches(lower(line), '{furniture}'))
            ) AS bad FROM (
                SELECT *, len(list_filter({_words("line")}, lambda w: w IN ('|', '»', '›', '•', '·', '>', '->'))) AS dividers
                FROM measured WHERE n > 0)
        ), kept_lines AS (
            SELECT rid, sum(CASE WHEN bad THEN 0 ELSE n END) AS kept_words,
                count(*) - count(DISTINCT line) AS dups FROM judged GROUP BY rid
        ), counted AS (
            SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
                CAST(len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
                CAST(coalesce(kept_words, 0) AS BIGINT) AS kept_words
            FROM docs LEFT JOIN covered USING (rid) LEFT JOIN kept_lines USING (rid)
        ), failed AS (
            SELECT *, n_words < {cleaning.MIN_WORDS}
                OR 100 * n_repeat_words > {int(100 * cleaning.MAX_REPEATED)} * n_words AS base_failed FROM counted)
        SELECT *, NOT base_failed AND kept_words >= {cleaning.MIN_KEPT} * n_words AS kept FROM failed"""


_MAXSCORE = """
    WITH whole AS (
        SELECT row_number() OVER () AS place, vec_id,
            list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS terms
        FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    ), scored AS (
        SELECT q.place, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(
            list_zip(q.terms, c.terms), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM whole q JOIN whole c ON q.place <> c.place AND len(q.terms) = len(c.terms)
        WHERE q.vec_id % 50 = 0
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5"""


def _mix() -> str:
    weights = ", ".join(str(float(w)) for w in mixing.WEIGHTS)
    return f"""
        WITH sized AS (
            SELECT doc_id, source, CAST(len({_words("text")}) AS BIGINT) AS size FROM documents
        ), sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [{weights}][
                1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}] AS weight
            FROM sized GROUP BY source
        ), levels AS (
            SELECT *, {mixing.MOST}.0::DOUBLE * source_size AS ceiling,
                ({mixing.SHARE}::DOUBLE * sum(source_size) OVER ()
                    - coalesce(sum({mixing.MOST}.0::DOUBLE * source_size) OVER (ORDER BY {mixing.MOST} * source_size / weight, source
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY {mixing.MOST} * source_size / weight, source
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM sources
        ), levelled AS (
            SELECT source, source_size, least(
                (SELECT arg_min(level, ceiling / weight) FROM levels WHERE level * weight <= ceiling) * weight,
                ceiling) AS target FROM levels
        ), placed AS (
            SELECT s.*, source_size, target, target / source_size AS rate,
                row_number() OVER (PARTITION BY s.source ORDER BY size DESC, doc_id NULLS LAST) AS place
            FROM sized s JOIN levelled l ON s.source IS NOT DISTINCT FROM l.source
        ), drawn AS (
            SELECT *, CAST(('0x' || substr(md5('{mixing.SEED}|' || draw || '|' || coalesce(source, chr(0))), 1, 5))
                AS BIGINT) / 1048576.0::DOUBLE AS shift
            FROM placed, range({mixing.DRAWS}) AS r(draw)
        ), taken AS (
            SELECT *, CAST(size * (floor(place * rate + shift) - floor((place - 1) * rate + shift)) AS BIGINT) AS taken
            FROM drawn
        ), best AS (
            SELECT source, arg_min(shift, (abs(total - target), shift)) AS shift FROM (
                SELECT source, shift, sum(taken) AS total, any_value(target) AS target
                FROM taken GROUP BY source, draw, shift)
            GROUP BY source
        )
        SELECT doc_id, t.source, size, source_size, target, taken
        FROM taken t JOIN best b ON t.source IS NOT DISTINCT FROM b.source AND t.shift = b.shift"""


# Digests are built level by level with ordinary grouping; proofs and folding walk from each leaf.
_MERKLE = r"""
    WITH RECURSIVE field AS (
        SELECT doc_id, lang, row_number() OVER () AS rid,
            coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
            || coalesce(octet_length(encode(source)) || ':' || source, '-')
            || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
            coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS size,
            coalesce(octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) || ':' || (n_chars + 1), '-') AS size_forged,
            coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
            list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
                string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))) AS crc
        FROM documents
    ), leaf AS (
        SELECT rid, doc_id, lang, sha256(head || size || tail) AS leaf,
            CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(head || size_forged || tail) END AS forged FROM field
    ), placed AS (
        SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS n,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS idx FROM leaf
    ), level AS (
        SELECT 0 AS height, tree, idx, n, leaf AS digest FROM placed
        UNION ALL
        SELECT height + 1, tree, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx))
        FROM level WHERE n > 1 GROUP BY height, tree, idx // 2, n
    ), subroots AS (SELECT tree, digest AS subroot, count(*) OVER () AS n FROM level WHERE n = 1
    ), top AS (
        SELECT 0 AS height, tree AS idx, n, subroot AS digest FROM subroots
        UNION ALL
        SELECT height + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx))
        FROM top WHERE n > 1 GROUP BY height, idx // 2, n
    ), steps AS (
        SELECT p.rid, l.height, p.idx >> l.height & 1 AS slot, l.digest AS other
        FROM placed p JOIN level l ON l.tree = p.tree AND l.idx = xor(p.idx >> l.height, 1) AND l.n > 1
        UNION ALL
        SELECT p.rid, 100 + t.height, p.tree >> t.height & 1, t.digest
        FROM placed p JOIN top t ON t.idx = xor(p.tree >> t.height, 1) AND t.n > 1
    ), spans AS (
        SELECT p.rid, h.height FROM placed p JOIN (SELECT DISTINCT tree, height FROM level WHERE n > 1) h USING (tree)
        UNION ALL
        SELECT p.rid, 100 + h.height FROM placed p, (SELECT DISTINCT height FROM top WHERE n > 1) h
    ), numbered AS (
        SELECT rid, slot, other, row_number() OVER (PARTITION BY rid ORDER BY height) AS step
        FROM spans LEFT JOIN steps USING (rid, height)
    ), fold AS (
        SELECT rid, 0::BIGINT AS step, coalesce(forged, leaf) AS digest FROM placed
        UNION ALL
        SELECT rid, fold.step + 1, sha256(CASE WHEN other IS NULL THEN digest
            WHEN slot = 0 THEN digest || other ELSE other || digest END)
        FROM fold JOIN numbered USING (rid) WHERE numbered.step = fold.step + 1
    ), folded AS (SELECT rid, arg_max(digest, step) AS folded_root FROM fold GROUP BY rid
    ), proof AS (
        SELECT rid, sha256(coalesce(string_agg(other, '' ORDER BY step), '')) AS proof_sha256
        FROM placed LEFT JOIN numbered USING (rid) GROUP BY rid
    )
    SELECT doc_id, leaf, subroot, top.digest AS root, proof_sha256, folded_root, folded_root = top.digest AS verified
    FROM placed JOIN subroots USING (tree) JOIN folded USING (rid) JOIN proof USING (rid)
        JOIN top ON top.n = 1"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_LEXICAL = f"""
    WITH docs AS (
        SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS terms FROM documents
    ), corpus AS (
        SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS length FROM docs WHERE len(terms) > 0
    ), posting AS (
        SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM docs) GROUP BY rid, term
    ), weight AS (
        SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
        FROM posting, corpus GROUP BY term
    ), part AS (
        SELECT rid, doc_id, term,
            w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(terms) * docs) // length))) AS part
        FROM posting JOIN weight USING (term) JOIN docs USING (rid), corpus
    ), item AS (
        SELECT row_number() OVER () AS iid, item_id, {_TERMS} AS terms FROM benchmark
    ), scored AS (
        SELECT iid, item_id, rid, doc_id, CAST(sum(part) AS BIGINT) AS score
        FROM (SELECT iid, item_id, unnest(terms) AS term FROM item) JOIN part USING (term)
        GROUP BY iid, item_id, rid, doc_id
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank
        FROM scored WHERE score > 0
    )
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20"""


def statements() -> dict[str, str]:
    return {
        "op2_license_sentences": _license_sentences(),
        "op5_line_cleaning": _line_cleaning(),
        "op6_maxscore_top_k": _MAXSCORE,
        "op8_systematic_mix": _mix(),
        "op11_merkle_manifest": _MERKLE,
        "op13_shared_lexical_search": _LEXICAL,
    }
