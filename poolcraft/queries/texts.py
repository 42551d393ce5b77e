"""Queries on passages and facts of CVs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolcraft.functions import text as T
from poolcraft.operators import facts, passages, timestamps
from poolcraft.queries.instants_sql import instants
from poolcraft.session import load


def _cvs(spark: SparkSession, d: str) -> DataFrame:
    """One text per id: exact repeats aside, the table has one row per id; of several the greatest text counts."""
    return load(spark, d, "parsed", "id", "markdown").filter("markdown IS NOT NULL").groupBy("id").agg(F.max("markdown").alias("markdown"))


def unit_normalize_hash(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    return lines.filter(T.normalize(F.col("line")) != "").select("doc_id", "pos", T.passage_hash(F.col("line")).alias("h"))


def bullets_extract(spark: SparkSession, d: str) -> DataFrame:
    return passages.bullets(_cvs(spark, d)).select("id", "pos", F.md5("bullet").alias("h"))


def section_body(spark: SparkSession, d: str) -> DataFrame:
    cut = _cvs(spark, d).select("id", T.unified(F.col("markdown")).alias("l"))
    bodies = cut.select("id", T.section(F.col("l"), facts.SKILL_SECTIONS).alias("skills"), T.section(F.col("l"), facts.EDUCATION_SECTIONS).alias("education"))
    return bodies.select("id", F.md5("skills").alias("skills"), F.md5("education").alias("education"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    said = load(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return said.select("doc_id", F.size("s").alias("sentences"), F.md5(F.array_join("s", "\n")).alias("h"))


def quote_in_document(spark: SparkSession, d: str) -> DataFrame:
    """Shared bullets of the older pass, as quotes looked up in the CV they are said to come from."""
    quotes = load(spark, d, "prechecks", "candidate_id", "pool_duplicate_bullets").select(F.col("candidate_id").alias("id"), F.explode("pool_duplicate_bullets.bullet").alias("quote")).distinct()
    joined = quotes.filter("quote IS NOT NULL").join(_cvs(spark, d), "id")
    return joined.groupBy("id").agg(F.count(F.lit(1)).alias("quotes"), F.count_if(T.contains_quote(F.col("markdown"), F.col("quote"))).alias("found"))


def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Each shared bullet of a candidate against the first of the same list, once per pair of texts."""
    lists = load(spark, d, "prechecks", "candidate_id", "pool_duplicate_bullets").select("candidate_id", F.expr("pool_duplicate_bullets.bullet").alias("l")).filter("size(l) > 0")
    pairs = lists.select("candidate_id", F.col("l")[0].alias("a"), F.explode("l").alias("b")).distinct().filter("a IS NOT NULL AND b IS NOT NULL")
    sets = pairs.select("candidate_id", F.md5("a").alias("a"), F.md5("b").alias("b"), T.words(F.col("a")).alias("x"), T.words(F.col("b")).alias("y"))
    return sets.select("candidate_id", "a", "b", F.bround(T.jaccard(F.col("x"), F.col("y")), 3).alias("similarity"))


def placeholder_scan(spark: SparkSession, d: str) -> DataFrame:
    return facts.placeholders(_cvs(spark, d)).select("id", F.lower("match").alias("match"))


def bullet_style(spark: SparkSession, d: str) -> DataFrame:
    return facts.bullet_style(_cvs(spark, d))


def skills_count(spark: SparkSession, d: str) -> DataFrame:
    return facts.skills(_cvs(spark, d))


def degree_level(spark: SparkSession, d: str) -> DataFrame:
    return facts.degrees(_cvs(spark, d))


def date_ranges_extract(spark: SparkSession, d: str) -> DataFrame:
    return facts.date_ranges(_cvs(spark, d)).select("id", "first", "last", "precise", "raw")


def hidden_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = facts.hidden_spans(load(spark, d, "parsed", "id", "hidden_text").filter("hidden_text IS NOT NULL").distinct())
    return spans.groupBy("id").agg(F.count(F.lit(1)).alias("spans"), F.bool_or("substantive").alias("found"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def _people(spark: SparkSession, d: str) -> DataFrame:
    """One row per candidate: the snapshot with the latest updated_date, read as an instant; unreadable ones come first, of equal ones the greatest values count."""
    rows = load(spark, d, "candidates", "id", "opening_id", "updated_date", "first_name", "last_name", "email", "phone", "profile_data")
    timed = timestamps.normalise(rows, load(spark, d, "openings", "opening_id", "tz_name", "date_order"), "opening_id", "updated_date")
    return timed.groupBy("id").agg(F.max(F.struct("epoch_us", "first_name", "last_name", "email", "phone", "profile_data")).alias("r")).select("id", "r.*")


def profile_link(spark: SparkSession, d: str) -> DataFrame:
    return facts.profile_links(_people(spark, d), _cvs(spark, d), host=r"proflink\.example", paths="in").select("id", "present", "source", "url")


def slug_name_match(spark: SparkSession, d: str) -> DataFrame:
    """The local part of a candidate's e-mail against the name, as a profile's slug would be."""
    slug = F.regexp_extract(F.lower("email"), r"^([a-z0-9_%.+-]+)@", 1)
    rows = _people(spark, d).filter("email IS NOT NULL").select("id", F.regexp_replace(slug, "[.+]", "-").alias("slug"), F.concat_ws(" ", "first_name", "last_name").alias("name"))
    return rows.select("id", facts.slug_matches_name(F.col("slug"), F.col("name")).alias("matches"))


def labelled_fields(spark: SparkSession, d: str) -> DataFrame:
    """Exact-label lookups in the records' fields: residence, sponsorship, region."""
    p = F.col("profile_data")
    rows = _people(spark, d).select("id", T.labelled_value(p, ["city of residence", "location", "city"], facts.NOT_A_PLACE).alias("residence"), T.labelled_value(p, ["do you need sponsorship"]).alias("answer"), T.labelled_value(p, ["region"]).alias("region"))
    return rows.select("id", "residence", facts.is_residence(F.col("residence")).alias("abroad"), facts.answered(F.col("answer")).alias("sponsorship"), T.first_contained(F.col("region"), facts.REGION_HINTS).alias("zone"))


def header_state_zone(spark: SparkSession, d: str) -> DataFrame:
    head = F.array_join(F.slice(F.filter(T.lines(F.col("markdown")), lambda x: F.trim(x) != ""), 1, 12), "\n")
    return _cvs(spark, d).select("id", facts.state_zone(head).alias("zone"))


def separated_team_claims(spark: SparkSession, d: str) -> DataFrame:
    claims = facts.separated_team_claims(_cvs(spark, d))
    return claims.select("id", F.md5("sentence").alias("sentence"), F.array_join("places", ",").alias("places"))


def pool_duplicate_counts(spark: SparkSession, d: str) -> DataFrame:
    return passages.shared_counts(passages.bullets(_cvs(spark, d)))


def pool_duplicate_passages(spark: SparkSession, d: str) -> DataFrame:
    return passages.shared_passages(passages.bullets(_cvs(spark, d))).select("h", "owners", "first_owner")


def pool_duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    """Which documents share which passage: (h, id, bullet)."""
    return passages.members(passages.bullets(_cvs(spark, d)))


def intra_doc_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return passages.near_within(passages.bullets(_cvs(spark, d)))


_NAMES = (
    unit_normalize_hash, bullets_extract, section_body, sentence_split, quote_in_document, token_jaccard, placeholder_scan, bullet_style, skills_count, degree_level, date_ranges_extract,
    hidden_spans, profile_link, slug_name_match, labelled_fields, header_state_zone, separated_team_claims, pool_duplicate_counts, pool_duplicate_passages, pool_duplicate_members, intra_doc_near_duplicates,
)
QUERIES = {f.__name__: f for f in _NAMES}

# --- the same in SQL ----------------------------------------------------------------------------------------------------

_SEP = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_CVS = "cv AS (SELECT id, max(markdown) AS markdown FROM parsed WHERE markdown IS NOT NULL GROUP BY id)"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({_norm(x)}, ' '), lambda w: w <> '' AND NOT regexp_full_match(w, '[0-9]+')))"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _split(x: str) -> str:
    return f"regexp_split_to_array({x}, '{_SEP}')"


_LINES = f"{_CVS}, cut AS (SELECT id, {_split('markdown')} AS l FROM cv), line AS (SELECT id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM cut)"
_BULLETS = _LINES + r""", bullet AS (SELECT id, pos, trim(regexp_replace(regexp_extract(line, '^\s*(?:[-*+]|\d+[.)])\s+(.*\S)\s*$', 1), '[*_`]{1,3}', '', 'g')) AS bullet
    FROM line WHERE regexp_matches(line, '^\s*(?:[-*+]|\d+[.)])\s+(.*\S)\s*$')), b AS (SELECT * FROM bullet WHERE bullet <> '')"""
_HASHED = _BULLETS + f""", n AS (SELECT id, pos, bullet, {_norm('bullet')} AS n FROM b), h AS (SELECT id, pos, bullet, n, substr(sha1(n), 1, 16) AS h FROM n WHERE n <> '' AND len(string_split(n, ' ')) >= 6),
    own AS (SELECT h, id FROM h GROUP BY h, id), size AS (SELECT h, count(*) AS n, min(id) AS first_owner FROM own GROUP BY h HAVING count(*) > 1)"""  # fmt: skip


def _section(names: tuple[str, ...], lines: str = "l") -> str:
    """Body of a section as a scalar expression over the list of lines."""
    level = r"len(regexp_extract({x}, '^\s{{0,3}}(#{{1,6}})\s+(.*\S)\s*$', 1))"
    title = r"lower(regexp_extract(x, '^\s{0,3}(#{1,6})\s+(.*\S)\s*$', 2))"
    hit = f"list_position(list_transform({lines}, lambda x: {level.format(x='x')} > 0 AND regexp_matches({title}, '{'|'.join(names)}')), true)"
    rest = f"{lines}[({hit}) + 1:]"
    stop = f"list_position(list_transform({rest}, lambda x: {level.format(x='x')} > 0 AND {level.format(x='x')} <= {level.format(x=f'{lines}[{hit}]')}), true)"
    body = f"array_to_string(CASE WHEN coalesce({stop}, 0) > 0 THEN ({rest})[:({stop}) - 1] ELSE {rest} END, E'\\n')"
    return f"CASE WHEN coalesce({hit}, 0) > 0 THEN nullif({_strip(body)}, '') END"


_PEOPLE = f"""snapshot AS (SELECT c.id, first_name, last_name, email, phone, profile_data, updated_date AS value, tz_name, date_order FROM candidates c LEFT JOIN openings USING (opening_id)), {instants("snapshot")},
top AS (SELECT id, max(us) AS u FROM instant GROUP BY id), p0 AS (SELECT c.* FROM instant c JOIN top t ON c.id = t.id AND c.us IS NOT DISTINCT FROM t.u),
person AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY first_name DESC NULLS LAST, last_name DESC NULLS LAST, email DESC NULLS LAST, phone DESC NULLS LAST, profile_data DESC NULLS LAST) AS k FROM p0) WHERE k = 1)"""


def _field(labels: list[str], unlike: str = "") -> str:
    listed = ", ".join(f"'{x}'" for x in labels)
    place = f" AND NOT regexp_matches(f.value, '{unlike}')" if unlike else ""
    return f"trim(list_filter(profile_data, lambda f: {_norm('f.name')} IN ({listed}) AND trim(f.value) <> ''{place})[1].value)"


def _case(pairs: tuple[tuple[str, str], ...], test: str) -> str:
    return "CASE " + " ".join(f"WHEN {test.format(p)} THEN '{v}'" for p, v in pairs) + " END"


_PLACES = "|".join([facts.REGIONS])
_SENTENCES = rf"""list_filter(list_transform(flatten(list_transform({{lines}}, lambda x: string_split(regexp_replace(regexp_replace(regexp_replace(x, '^\s*(?:[-*+]|\d+[.)])\s+', ''), '[*_`]{{{{1,3}}}}', '', 'g'),
    '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))), lambda x: {_strip('x').replace('{', '{{{{').replace('}', '}}}}')}), lambda x: x <> '')"""
_HIGHER = {
    "zone": "map_from_entries([" + ", ".join(f"('{s}', '{z}')" for z, states in facts.STATE_ZONES.items() for s in states.split()) + "])",
    "months": "map_from_entries([" + ", ".join(f"('{k}', {v})" for k, v in facts.MONTHS.items()) + "])",
}


def _month(name: str, number: str) -> str:
    return f"coalesce(TRY_CAST(nullif({number}, '') AS INT), {_HIGHER['months']}[lower({name})])"


def _groups(pattern: str, body: str, n: int) -> str:
    return ", ".join(f"unnest(regexp_extract_all({body}, '{pattern}', {g})) AS g{g}" for g in range(n))


SQL = {
    "unit_normalize_hash": f"""WITH cut AS (SELECT doc_id, {_split('text')} AS l FROM documents), line AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS line FROM cut)
        SELECT doc_id, pos, substr(sha1({_norm('line')}), 1, 16) AS h FROM line WHERE {_norm('line')} <> ''""",
    "bullets_extract": f"WITH {_BULLETS} SELECT id, pos::INT AS pos, md5(bullet) AS h FROM b",
    "section_body": f"WITH {_CVS}, cut AS (SELECT id, {_split('markdown')} AS l FROM cv) SELECT id, md5({_section(facts.SKILL_SECTIONS)}) AS skills, md5({_section(facts.EDUCATION_SECTIONS)}) AS education FROM cut",
    "sentence_split": f"""WITH cut AS (SELECT doc_id, {_split('text')} AS l FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, {_SENTENCES.format(lines='l').replace('{{', '{').replace('}}', '}')} AS s FROM cut)
        SELECT doc_id, len(s)::INT AS sentences, md5(array_to_string(s, E'\\n')) AS h FROM s""",
    "quote_in_document": rf"""WITH {_CVS}, q AS (SELECT DISTINCT candidate_id AS id, unnest(pool_duplicate_bullets).bullet AS quote FROM prechecks),
        j AS (SELECT id, lower(trim(regexp_replace(markdown, '\s+', ' ', 'g'))) AS t, lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))) AS q FROM q JOIN cv USING (id) WHERE quote IS NOT NULL)
        SELECT id, count(*) AS quotes, count(*) FILTER (q <> '' AND contains(t, q)) AS found FROM j GROUP BY id""",
    "token_jaccard": f"""WITH p AS (SELECT candidate_id, pool_duplicate_bullets[1].bullet AS a, unnest(pool_duplicate_bullets).bullet AS b FROM prechecks), d AS (SELECT DISTINCT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL),
        w AS (SELECT candidate_id, md5(a) AS a, md5(b) AS b, {_words('d.a')} AS x, {_words('d.b')} AS y FROM d), s AS (SELECT *, len(list_intersect(x, y)) AS n FROM w)
        SELECT candidate_id, a, b, CASE WHEN len(x) > 0 AND len(y) > 0 THEN round_even(n / (len(x) + len(y) - n)::DOUBLE, 3) ELSE 0.0::DOUBLE END AS similarity FROM s""",
    "placeholder_scan": f"WITH {_CVS}, m AS (" + " UNION ALL ".join(f"SELECT id, unnest(regexp_extract_all(markdown, '{p}')) AS m FROM cv" for p in facts.PLACEHOLDERS) + ") SELECT DISTINCT id, lower(trim(m)) AS match FROM m",
    "bullet_style": rf"""WITH {_BULLETS}, j AS (SELECT id, bullet, string_split({_norm('bullet')}, ' ')[1] IN ({', '.join(f"'{v}'" for v in facts.POWER_VERBS)}) AS power,
            list_transform(regexp_extract_all(bullet, '\b(\d{{1,3}})\s?%', 1), lambda x: x::INT) AS n FROM b),
        f AS (SELECT id, power, len(n) > 0 AS metric, len(n) > 0 AND len(list_filter(n, lambda v: contains(bullet, v || '.') OR contains(bullet, '.' || v) OR v % 5 <> 0)) = 0 AS round FROM j)
        SELECT id, count(*) AS bullet_count, round_even(avg(power::INT), 3) AS power_verb_density, count(*) FILTER (metric) AS metric_count,
            CASE WHEN count(*) FILTER (metric) > 0 THEN round_even(count(*) FILTER (round) / count(*) FILTER (metric)::DOUBLE, 3) ELSE 0.0::DOUBLE END AS round_metric_ratio FROM f GROUP BY id""",
    "skills_count": f"""WITH {_CVS}, cut AS (SELECT id, {_split('markdown')} AS l FROM cv), s AS (SELECT id, {_section(facts.SKILL_SECTIONS)} AS body FROM cut)
        SELECT id, coalesce(len(list_distinct(list_filter(list_transform(regexp_split_to_array(body, '[,;|/•\\n]+'), lambda x: {_norm('x')}), lambda x: len(x) > 1))), 0)::INT AS skills_count FROM s""",
    "degree_level": f"""WITH {_CVS}, cut AS (SELECT id, markdown, {_split('markdown')} AS l FROM cv), s AS (SELECT id, coalesce({_section(facts.EDUCATION_SECTIONS)}, markdown) AS body FROM cut),
        g AS (SELECT id, body, {_case(tuple((p.replace("'", "''"), v) for p, v in facts.DEGREES), "regexp_matches(body, '{}')")} AS level FROM s)
        SELECT id, level IS NOT NULL AS present, level, CASE WHEN level IS NOT NULL THEN coalesce(nullif(trim(regexp_extract(body, '{facts.DEGREE_FIELD}', 1)), ''), nullif(regexp_extract(body, '{facts.DEGREE_FIELD}', 2), '')) END AS field FROM g""",
    "date_ranges_extract": f"""WITH {_CVS}, cut AS (SELECT id, markdown, {_split('markdown')} AS l FROM cv),
        s AS (SELECT id, coalesce({_section(facts.EXPERIENCE_SECTIONS)}, CASE WHEN {_section(('education',))} IS NULL THEN markdown END) AS body FROM cut), m AS (SELECT id, {_groups(facts.DATE_RANGE, 'body', 8)} FROM s)
        SELECT id, g2::INT * 12 + coalesce({_month('g1', 'g3')}, 1) - 1 AS first, CASE WHEN coalesce(g7, '') = '' THEN TRY_CAST(g5 AS INT) * 12 + coalesce({_month('g4', 'g6')}, 1) - 1 END AS last,
            {_month('g1', 'g3')} IS NOT NULL AND (coalesce(g7, '') <> '' OR {_month('g4', 'g6')} IS NOT NULL) AS precise, trim(g0) AS raw FROM m""",
    "hidden_spans": r"""WITH d AS (SELECT DISTINCT id, hidden_text FROM parsed WHERE hidden_text IS NOT NULL), s AS (SELECT id, unnest(hidden_text.spans) AS s FROM d), t AS (SELECT id, s.kind AS kind, s.text AS text FROM s WHERE trim(s.text) <> '')
        SELECT id, count(*) AS spans, bool_or(len(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+#.\-]*')) >= 5 AND len(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 25) AS found,
            array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds FROM t GROUP BY id""",
    "profile_link": rf"""WITH {_CVS}, {_PEOPLE}, f AS (SELECT p.id, {_field(['linkedin', 'linkedin profile', 'linkedin url'])} AS f, markdown AS t FROM person p LEFT JOIN cv ON p.id = cv.id),
        m AS (SELECT id, regexp_extract(f, '(?i)(?:https?://)?(?:[a-z]{{2,3}}\.)?proflink\.example/(?:in)/([A-Za-z0-9\-_%]+)', 0) AS fu, regexp_extract(f, '(?i)proflink\.example/(?:in)/([A-Za-z0-9\-_%]+)', 1) AS fs,
            regexp_extract(t, '(?i)(?:https?://)?(?:[a-z]{{2,3}}\.)?proflink\.example/(?:in)/([A-Za-z0-9\-_%]+)', 0) AS tu, regexp_extract(t, '(?i)proflink\.example/(?:in)/([A-Za-z0-9\-_%]+)', 1) AS ts FROM f),
        v AS (SELECT id, CASE WHEN len(fs) >= 3 THEN fu END AS fu, CASE WHEN len(ts) >= 3 THEN tu END AS tu FROM m), u AS (SELECT id, fu, tu, coalesce(fu, tu) AS url FROM v)
        SELECT id, url IS NOT NULL AS present, CASE WHEN fu IS NOT NULL THEN 'record' WHEN tu IS NOT NULL THEN 'text' ELSE 'none' END AS source,
            CASE WHEN lower(url) LIKE 'https://%' THEN url WHEN lower(url) LIKE 'http://%' THEN 'https://' || substr(url, 8) WHEN url IS NOT NULL THEN 'https://' || url END AS url FROM u""",
    "slug_name_match": rf"""WITH {_PEOPLE}, s AS (SELECT id, regexp_replace(regexp_extract(lower(email), '^([a-z0-9_%.+-]+)@', 1), '[.+]', '-', 'g') AS slug, {_norm("concat_ws(' ', first_name, last_name)")} AS name FROM person WHERE email IS NOT NULL),
        t AS (SELECT id, list_filter(regexp_split_to_array(slug, '[-_%\d]+'), lambda x: len(x) > 2) AS parts, list_filter(string_split(name, ' '), lambda x: len(x) > 2) AS names, regexp_replace(slug, '[-_%\d]+', '', 'g') AS joined FROM s)
        SELECT id, CASE WHEN len(parts) > 0 AND len(names) > 0 THEN CASE WHEN list_has_any(parts, names) OR (joined <> '' AND joined IN (array_to_string(names, ''), array_to_string(list_reverse(names), ''))) THEN true
            WHEN len(list_filter(parts, lambda x: len(x) > 3)) > 0 THEN false END END AS matches FROM t""",
    "labelled_fields": rf"""WITH {_PEOPLE}, f AS (SELECT id, {_field(['city of residence', 'location', 'city'], facts.NOT_A_PLACE)} AS residence, {_field(['do you need sponsorship'])} AS answer, lower({_field(['region'])}) AS region FROM person),
        g AS (SELECT *, lower(regexp_replace(trim(residence), '\.+$', '')) AS low FROM f)
        SELECT id, residence, coalesce(NOT regexp_matches(residence, '{facts.NOT_A_PLACE}') AND NOT regexp_matches(residence, '{facts.INTENT}') AND len(regexp_split_to_array(trim(string_split(low, ',')[-1]), '\s+')) <= 3
            AND regexp_matches(low, '(?:{facts.COUNTRIES})$'), false) AS abroad, CASE WHEN lower(trim(answer)) IN ('no', 'no.', 'n/a', 'none', 'not required') THEN false WHEN lower(trim(answer)) LIKE 'yes%' THEN true END AS sponsorship,
            {_case(facts.REGION_HINTS, "contains(region, '{}')")} AS zone FROM g""",
    "header_state_zone": rf"""WITH {_CVS}, h AS (SELECT id, array_to_string(list_filter({_split('markdown')}, lambda x: trim(x) <> '')[:12], E'\n') AS head FROM cv)
        SELECT id, list_filter(list_transform(regexp_extract_all(head, ',\s*([A-Z]{{2}})\b', 1), lambda c: {_HIGHER['zone']}[c]), lambda z: z IS NOT NULL)[1] AS zone FROM h""",
    "separated_team_claims": rf"""WITH {_CVS}, cut AS (SELECT id, {_split('markdown')} AS l FROM cv),
        s AS (SELECT id, {_SENTENCES.format(lines='l').replace('{{', '{').replace('}}', '}')} AS s FROM cut), u AS (SELECT id, generate_subscripts(s, 1) AS pos, unnest(s) AS sentence FROM s),
        f AS (SELECT *, {_norm('sentence')} AS n, list_sort(list_distinct(list_transform(regexp_extract_all(sentence, '(?i)\b(?:{facts.REGIONS})\b'), lambda x: lower(x)))) AS places FROM u),
        h AS (SELECT *, row_number() OVER (PARTITION BY id, n ORDER BY pos) AS k FROM f WHERE n <> '' AND (regexp_matches(sentence, '(?i)\b(?:offshore|offshored|nearshore)\b')
            OR (len(places) > 0 AND regexp_matches(sentence, '(?i)\bteams?\b|\bengineers?\b|\bdevelopers?\b|\bcollaborat\w*\b|\bpartner\w*\b|\bcoordinat\w*\b'))))
        SELECT id, md5(sentence) AS sentence, array_to_string(places, ',') AS places FROM h WHERE k = 1""",
    "pool_duplicate_counts": f"WITH {_HASHED} SELECT own.id, count(*) AS passages, sum(size.n - 1)::BIGINT AS partners FROM own JOIN size USING (h) GROUP BY own.id",
    "pool_duplicate_passages": f"WITH {_HASHED} SELECT h, n AS owners, first_owner FROM size",
    "pool_duplicate_members": f"WITH {_HASHED} SELECT h.h, h.id, arg_max(h.bullet, h.pos) AS bullet FROM h JOIN size USING (h) GROUP BY h.h, h.id",
    "intra_doc_near_duplicates": f"""WITH {_HASHED}, w AS (SELECT id, pos, {_words('bullet')} AS w FROM h), p AS (SELECT a.id, a.pos AS pos_a, b.pos AS pos_b, len(a.w) AS x, len(b.w) AS y, len(list_intersect(a.w, b.w)) AS n
            FROM w a JOIN w b ON a.id = b.id AND a.pos < b.pos)
        SELECT id, pos_a::INT AS pos_a, pos_b::INT AS pos_b, round_even(n / (x + y - n)::DOUBLE, 3) AS similarity FROM p WHERE x > 0 AND y > 0 AND n / (x + y - n)::DOUBLE >= 0.85""",
}
