"""Column functions over whole tables."""

from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.catalog import query, sql_list
from leadloom.catalog.gates import fingerprint_sql
from leadloom.functions import codes, mailboxes, text, utility
from leadloom.operators import contacts, drafts, evidence
from leadloom.operators.compliance import mark_suppressed
from leadloom.standins import EVENTS_AS_OF, pick



@query("f1_strip_accents", "SELECT doc_id, sha256(strip_accents(text)) AS plain FROM documents")
def f1(t):
    return t.documents.select("doc_id", F.sha2(text.strip_accents(F.col("text")), 256).alias("plain"))


@query("f2_normalize_space", r"""
SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
  '&#39;', ''''), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&'), '[\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) AS tidy FROM pages
""")
def f2(t):
    return t.pages.select("page_id", F.sha2(text.normalize_space(F.col("html")), 256).alias("tidy"))


@query("f3_person_name", r"""
SELECT id, trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(strip_accents(full_name)), '\s+', ' ', 'g')), '^(m(me|lle)?|monsieur|madame|dr)\.?\s+', ''), '[^a-z0-9'' -]', '', 'g')) AS name
FROM (SELECT ord AS id, full_name FROM s_person_facts UNION ALL SELECT doc_id, replace(substring(text, 1, 0) || text, chr(8217), '''') FROM documents WHERE text NOT LIKE '%&%') x
""")
def f3(t):
    names = t.s_person_facts.select(F.col("ord").alias("id"), "full_name").unionByName(
        t.documents.filter(~F.col("text").contains("&")).select(F.col("doc_id").alias("id"), F.col("text").alias("full_name"))
    )
    return names.select("id", text.normalize_person_name(F.col("full_name")).alias("name"))


_PLAIN = "text"
for _entity, _sign in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
    _PLAIN = f"replace({_PLAIN}, '{_entity}', {_sign})"


@query("f3b_person_name_in_any_text", rf"""
WITH d AS (SELECT doc_id, trim(regexp_replace({_PLAIN}, '[\s\x0B\x1C-\x1F\x85\xA0\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g')) AS tidy FROM documents)
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(replace(lower(strip_accents(tidy)), chr(8217), ''''), '^(m(me|lle)?|monsieur|madame|dr)\.?\s+', ''), '[^a-z0-9'' -]', '', 'g'))) AS name FROM d
""")
def f3b(t):
    return t.documents.select("doc_id", F.sha2(text.normalize_person_name(F.col("text")), 256).alias("name"))


_ROLE_CASES = " ".join(f"WHEN contains(w, '{term}') THEN '{category}:{score}'" for term, category, score in fixed.ROLE_TERMS)


@query("f4_role", rf"""
WITH w AS (SELECT ord, trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce(job_title, ''))), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS w FROM s_person_facts)
SELECT ord, CASE WHEN w = '' THEN 'unknown' ELSE w END AS role, CASE {_ROLE_CASES} WHEN w <> '' THEN 'other:20' ELSE 'unknown:0' END AS category_score FROM w
""")
def f4(t):
    out = t.s_person_facts.withColumn("r", text.normalize_role(F.col("job_title")))
    return out.select("ord", F.col("r.role").alias("role"), F.concat_ws(":", "r.category", F.col("r.score").cast("string")).alias("category_score"))


@query("f5_email", r"""
WITH e AS (SELECT ord, lower(trim(trim(value), '.,;:<>[]()"''')) AS m FROM s_point_facts)
SELECT ord, CASE WHEN length(m) <= 320 AND regexp_full_match(m, '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,24}') AND NOT contains(m, '..') AND m NOT LIKE '.%'
  AND NOT contains(m, '.@') AND NOT regexp_matches(m, '@[-.]') THEN m END AS email FROM e
""")
def f5(t):
    return t.s_point_facts.select("ord", text.normalize_email(F.col("value")).alias("email"))


@query("f6_emails_in_text")
def f6(t):
    return t.documents.select("doc_id", F.array_join(text.extract_emails(F.col("text")), " ").alias("emails"))


_PHONE_FORMS = """
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '0' || lpad(CAST(o_orderkey % 1000000000 AS STRING), 9, '1') WHEN 1 THEN '0033 1 44 55 66 ' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0')
  WHEN 2 THEN '+44 (20) 7946-' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') WHEN 3 THEN '12 34' WHEN 4 THEN '33.1.44.55.66.77' WHEN 5 THEN '+1234' ELSE NULL END AS raw FROM """


@query("f7_phone", f"""
WITH r AS (SELECT o_orderkey, regexp_replace(regexp_replace(raw, '^00', '+'), '[^0-9+]', '', 'g') AS c FROM ({_PHONE_FORMS} orders) x),
d AS (SELECT *, replace(c, '+', '') AS n FROM r)
SELECT o_orderkey, CASE WHEN length(n) = 10 AND n LIKE '0%' THEN '+33' || substring(n, 2) WHEN length(n) = 11 AND n LIKE '33%' THEN '+' || n
  WHEN c LIKE '+%' AND length(n) BETWEEN 8 AND 15 THEN c END AS phone FROM d
""")
def f7(t):
    raw = t.spark.sql(_PHONE_FORMS + "{orders}", orders=t.orders)
    return raw.select("o_orderkey", text.normalize_phone(F.col("raw")).alias("phone"))


@query("f8_redact", """
SELECT ord, CASE WHEN contains(value, '@') THEN split_part(value, '@', 1)[1] || '***@' || substring(value, instr(value, '@') + 1) ELSE '[redacted]' END AS shown FROM s_point_facts
""")
def f8(t):
    return t.s_point_facts.select("ord", text.redact_email(F.col("value")).alias("shown"))


_FORM_CASES = " ".join(f"WHEN regexp_matches(h, '{'|'.join(terms)}') THEN '{label}'" for label, terms in fixed.FORM_CLASSES)


@query("f9_form_class", f"""
WITH f AS (SELECT page_id, lower(strip_accents(url || ' ' || html || ' ')) AS h FROM s_site_pages) SELECT page_id, CASE {_FORM_CASES} ELSE 'unknown' END AS form_class FROM f
""")
def f9(t):
    return t.s_site_pages.select("page_id", text.classify_form(F.col("url"), F.col("html"), F.lit("")).alias("form_class"))


@query("f10_company_name", r"""
SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(company_name)), '[^\p{L}\p{N}\p{M}_\s]', '', 'g'),
  '\b(limited|ltd|plc|llp|sas|sasu|sarl|sa|gmbh)\b', '', 'g'), '\s+', ' ', 'g')) AS name FROM s_prospects
""")
def f10(t):
    return t.s_prospects.select("id", text.normalize_company_name(F.col("company_name")).alias("name"))


@query("f11_domains", """
SELECT id, CASE WHEN contains(email, '@') THEN lower(trim(split_part(email, '@', 2))) WHEN website IS NOT NULL THEN
    regexp_replace(split_part(regexp_replace(website, '^https?://', ''), '/', 1), '^www[.]', '') END AS domain,
  regexp_replace(split_part(split_part(regexp_replace(lower(website), '^https?://', ''), '/', 1), ':', 1), '^www[.]', '') AS normalized FROM s_prospects
""")
def f11(t):
    return t.s_prospects.select(
        "id",
        text.extract_domain(F.col("website"), F.col("email")).alias("domain"),
        text.normalize_domain(F.col("website")).alias("normalized"),
    )


@query("f12_activity_codes", f"""
WITH n AS (SELECT id, upper(replace(replace(naf_code, '.', ''), ' ', '')) AS c, substring(upper(replace(naf_code, '.', '')), 1, 2) AS p FROM s_prospects)
SELECT id, c AS code, coalesce(p IN ('33', '43', '81') OR c IN ({sql_list(fixed.FIELD_NAF_CODES)}), FALSE) AS is_field,
  coalesce(p IN ('58', '61', '62', '63'), FALSE) AS is_digital,
  CASE WHEN c IS NULL THEN 'Other' WHEN p = '81' THEN 'Facilities / Maintenance' WHEN p IN ('33', '43') OR c IN ({sql_list(fixed.FIELD_NAF_CODES)}) THEN 'Field Services'
    WHEN p IN ('58', '61', '62', '63') THEN 'IT / Digital' WHEN p IN ('41', '42') THEN 'Construction' WHEN CAST(p AS INT) BETWEEN 10 AND 32 THEN 'Manufacturing'
    WHEN CAST(p AS INT) BETWEEN 49 AND 53 THEN 'Logistics' WHEN p IN ('71', '72') THEN 'Engineering'
    WHEN p IN ('69', '70', '73', '74', '78', '82') THEN 'Professional Services' ELSE 'Other' END AS sector FROM n
""")
def f12(t):
    naf = F.col("naf_code")
    return t.s_prospects.select(
        "id", codes.normalize_naf(naf).alias("code"), codes.is_field_naf(naf).alias("is_field"),
        codes.is_digital_naf(naf).alias("is_digital"), codes.naf_sector(naf).alias("sector"),
    )


_BANDS = "CASE o_orderkey % 19 WHEN 16 THEN ' nn ' WHEN 17 THEN 'zz' WHEN 18 THEN NULL ELSE " + pick(
    "o_orderkey % 19", *[code for code in fixed.HEADCOUNT_SIZES]
) + " END"


@query("f13_headcount", f"""
WITH b AS (SELECT o_orderkey, upper(trim({_BANDS})) AS band FROM orders)
SELECT o_orderkey, CASE WHEN band IN ('00', '01', '02', '03', '11') THEN '1-10' WHEN band IN ('12', '21', '22') THEN '11-50'
  WHEN band IN ('31', '32', '41') THEN '51-200' WHEN band IN ('42', '51', '52', '53') THEN '200+' ELSE 'unknown' END AS size FROM b
""")
def f13(t):
    raw = t.orders.select("o_orderkey", F.expr(_BANDS).alias("band"))
    return raw.select("o_orderkey", codes.headcount_size(F.col("band")).alias("size"))


@query("f14_fingerprints", f"""
SELECT id, {fingerprint_sql()} AS commercial FROM s_evidence
""")
def f14(t):
    fp = text.evidence_fingerprint(F.col("source_type"), F.col("signal_type"), F.col("evidence_text"), F.col("evidence_url"))
    return t.s_evidence.select("id", fp.alias("commercial"))


@query("f14b_contact_fingerprint", """
SELECT id, sha256(CAST(prospect_id AS VARCHAR) || '|' || source_adapter || '|' || coalesce(source_url, '') || '|' || evidence_type || '|' || coalesce(contact_value, '')
  || '|' || CASE person_name WHEN 'Jean Martin' THEN 'jean martin' WHEN 'Mme Élodie Martin-Dupont' THEN 'elodie martin-dupont' WHEN 'Dr. Luc Robert' THEN 'luc robert'
  WHEN 'Marie Durand' THEN 'marie durand' WHEN 'Paul Petit' THEN 'paul petit' ELSE '' END || '|') AS fingerprint FROM s_contact_evidence
""")
def f14b(t):
    fp = text.contact_fingerprint(
        F.col("prospect_id"), F.col("source_adapter"), F.col("source_url"), F.col("evidence_type"), F.col("contact_value"),
        F.col("person_name"), F.col("content_hash"),
    )
    return t.s_contact_evidence.select("id", fp.alias("fingerprint"))


@query("f15_dates", """
SELECT prospect_id, id, CASE WHEN date NOT LIKE 'n%' THEN CAST(CAST(date AS DATE) AS VARCHAR) END AS day, count(*) AS copies FROM s_award_rows GROUP BY ALL
""")
def f15(t):
    days = t.s_award_rows.withColumn("day", text.parse_date(F.col("date")).cast("string"))
    return days.groupBy("prospect_id", "id", "day").agg(F.count(F.lit(1)).alias("copies"))


@query("f16_name_parts", """
WITH n AS (SELECT ord, string_split(full_name, ' ') AS p FROM s_person_facts)
SELECT ord, p[1] AS first, array_to_string(p[2:], ' ') AS rest, array_to_string(p[:-2], ' ') AS given, p[-1] AS last,
  array_to_string(list_transform(p, lambda x: upper(x[1]) || lower(x[2:])), ' ') AS titled FROM n
""")
def f16(t):
    name = F.col("full_name")
    split, parsed = text.split_name(name), text.parse_person_name(name)
    return t.s_person_facts.select(
        "ord", split["first"].alias("first"), split["rest"].alias("rest"), parsed["first"].alias("given"),
        parsed["last"].alias("last"), text.officer_name(F.upper(name), F.lit(None).cast("string")).alias("titled"),
    )


_NAMES = """SELECT ord, full_name, CASE full_name WHEN 'Jean Martin' THEN 'jean' WHEN 'Mme Élodie Martin-Dupont' THEN 'elodie' WHEN 'Dr. Luc Robert' THEN 'luc'
  WHEN 'Marie Durand' THEN 'marie' ELSE 'paul' END AS f, CASE full_name WHEN 'Jean Martin' THEN 'martin' WHEN 'Mme Élodie Martin-Dupont' THEN 'martindupont'
  WHEN 'Dr. Luc Robert' THEN 'robert' WHEN 'Marie Durand' THEN 'durand' ELSE 'petit' END AS l FROM s_person_facts"""


@query("f17_mailbox_patterns", f"""
WITH n AS ({_NAMES}),
m AS (SELECT ord, f, l, CASE ord % 10 WHEN 0 THEN f || '.' || l WHEN 1 THEN f || l WHEN 2 THEN f[1] || '.' || l WHEN 3 THEN f[1] || l WHEN 4 THEN l || '.' || f
  WHEN 5 THEN f || '.' || l[1] WHEN 6 THEN f WHEN 7 THEN l ELSE 'zz' END AS local FROM n)
SELECT ord, local, CASE ord % 10 WHEN 0 THEN 'firstname.lastname' WHEN 1 THEN 'firstnamelastname' WHEN 2 THEN 'f.lastname' WHEN 3 THEN 'firstinitiallastname'
  WHEN 4 THEN 'lastname.firstname' WHEN 5 THEN 'firstname.l' WHEN 6 THEN 'firstname' WHEN 7 THEN 'lastname' END AS pattern FROM m
""")
def f17(t):
    named = t.s_person_facts.select("ord", "full_name", mailboxes.name_tokens(F.col("full_name")).alias("n"))
    forms = mailboxes.rendered(F.col("n.first"), F.col("n.last"))
    local = F.coalesce(F.get(forms, (F.col("ord") % 10).cast("int"))["local"], F.lit("zz"))
    out = named.withColumn("local", local)
    pattern = mailboxes.identify_pattern(F.concat("local", F.lit("@x.fr")), F.col("full_name"))
    return out.select("ord", "local", pattern.alias("pattern"))


@query("f18a_pattern_candidates", f"""
WITH n AS (SELECT p.ord, p.prospect_id, p.full_name, f, l FROM ({_NAMES}) x JOIN s_person_facts p USING (ord)),
people AS (SELECT prospect_id, full_name, f, l FROM n GROUP BY ALL),
obs AS (SELECT 'c' || CAST(prospect_id - prospect_id % 3 AS VARCHAR) || '.example.fr' AS domain, CASE ord % 3 WHEN 0 THEN 'firstname.lastname' WHEN 1 THEN 'f.lastname' ELSE 'lastname' END AS pattern,
  ord % 3 AS k FROM n WHERE prospect_id % 4 <> 0 AND ord % 2 = 0),
pat AS (SELECT domain, pattern, count(*) AS observations, CASE k WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 7 END AS po FROM obs GROUP BY domain, pattern, k),
all_c AS (SELECT p.prospect_id, p.full_name, pat.pattern, pat.observations, pat.po, f, l, pat.domain FROM people p JOIN pat ON pat.domain = 'c' || CAST(p.prospect_id - prospect_id % 3 AS VARCHAR) || '.example.fr'
  UNION ALL SELECT p.prospect_id, p.full_name, b.pattern, 0, b.po, f, l, 'c' || CAST(p.prospect_id - prospect_id % 3 AS VARCHAR) || '.example.fr' FROM people p, (VALUES ('firstname.lastname', 0), ('f.lastname', 1)) b(pattern, po)
  WHERE 'c' || CAST(p.prospect_id - prospect_id % 3 AS VARCHAR) || '.example.fr' NOT IN (SELECT domain FROM pat)),
r AS (SELECT *, row_number() OVER (PARTITION BY prospect_id, full_name ORDER BY observations DESC, po) AS candidate_rank FROM all_c)
SELECT prospect_id, full_name, CASE pattern WHEN 'firstname.lastname' THEN f || '.' || l WHEN 'f.lastname' THEN f[1] || '.' || l ELSE l END || '@' || domain AS email,
  observations, candidate_rank, CASE WHEN observations >= 2 THEN 'exact_person_pattern_confirmed' ELSE 'name_only_guess' END AS person_match_state FROM r
""", whole="observations candidate_rank")
def f18a(t):
    domain = F.concat(F.lit("c"), (F.col("prospect_id") - F.col("prospect_id") % 3).cast("string"), F.lit(".example.fr"))
    facts = t.s_person_facts.withColumn("domain", domain)
    people = facts.select("prospect_id", "full_name", "domain").distinct()
    forms = facts.filter((F.col("prospect_id") % 4 != 0) & (F.col("ord") % 2 == 0)).withColumn("n", mailboxes.name_tokens(F.col("full_name")))
    shown = F.array(F.lit("firstname.lastname"), F.lit("f.lastname"), F.lit("lastname"))
    local = mailboxes.render_pattern(F.get(shown, (F.col("ord") % 3).cast("int")), F.col("n.first"), F.col("n.last"))
    pairs = forms.select("domain", F.concat(local, F.lit("@"), F.col("domain")).alias("email"), F.col("full_name").alias("person_name"))
    out = contacts.pattern_candidates(people, contacts.learn_patterns(pairs))
    return out.select("prospect_id", "full_name", "email", "observations", "candidate_rank", "person_match_state")


@query("f18b_email_candidates", f"""
WITH b AS (SELECT id, 'c' || CAST(id - id % 3 AS VARCHAR) || '.example.fr' AS d FROM s_prospects),
c AS (SELECT id, 'sales@' || d AS email, 'raw' AS pattern, 0 AS priority FROM b WHERE id % 3 = 0
  UNION ALL SELECT id, u.local || '@' || d, u.pattern, u.prio FROM b, (VALUES ('jean.martin', 'prenom.nom', 1), ('j.martin', 'p.nom', 2), ('jeanmartin', 'prenomnom', 3), ('martin.jean', 'nom.prenom', 4),
    ('jean_martin', 'prenom_nom', 5), ('jmartin', 'pnom', 6), ('martinj', 'nomp', 7), ('martin', 'nom', 8), ('jean', 'prenom', 9)) u(local, pattern, prio) WHERE id % 2 = 0
  UNION ALL SELECT id, r.local || '@' || d, 'role:' || r.local, 20 + r.i FROM b, (VALUES {", ".join(f"('{role}', {i})" for i, role in enumerate(fixed.ROLE_LOCAL_PARTS))}) r(local, i)),
f AS (SELECT *, row_number() OVER (PARTITION BY id, email ORDER BY priority) AS copy FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority) AS rn FROM f WHERE copy = 1)
SELECT id, email, pattern, priority, rn - 1 AS position FROM r
""", whole="priority position")
def f18b(t):
    k = F.col("id")
    rows = t.s_prospects.select(
        "id",
        F.concat(F.lit("c"), (k - k % 3).cast("string"), F.lit(".example.fr")).alias("domain"),
        F.when(k % 2 == 0, "Jéan Paul").alias("first_name"),
        F.when(k % 2 == 0, "Martin").alias("last_name"),
        F.when(k % 3 == 0, F.array(F.concat(F.lit(" Sales@c"), (k - k % 3).cast("string"), F.lit(".example.fr")), F.lit("x@other.fr"))).alias("harvested"),
    )
    return contacts.email_candidates(rows).select("id", "email", "pattern", "priority", "position")


UTILITY_SQL = """CASE WHEN {supp} THEN 'suppressed' WHEN {stale} THEN 'stale' WHEN deliverability_state = 'invalid' THEN 'invalid'
  WHEN deliverability_state IN ('catch_all', 'risky', 'indeterminate', 'error') THEN 'manual_confirmation_required'
  WHEN kind = 'contact_form' THEN 'usable_generic' WHEN kind IN ('phone', 'linkedin', 'generic_contact_page') THEN 'usable_role' WHEN kind <> 'email' THEN 'no_contact'
  WHEN {conf} THEN 'usable_personal' WHEN publication_state = 'published_personal' AND person_match_state IN ('exact_person_published', 'strong_person_match') THEN 'usable_personal'
  WHEN publication_state = 'published_role' OR person_match_state = 'role_mailbox' THEN 'usable_role'
  WHEN publication_state = 'published_generic' OR person_match_state = 'generic_company_mailbox' THEN 'usable_generic'
  WHEN person_match_state = 'exact_person_pattern_confirmed' THEN CASE WHEN deliverability_state = 'deliverable' THEN 'usable_personal' ELSE 'verification_required' END
  WHEN person_match_state IN ('pattern_inferred', 'name_only_guess') THEN 'manual_confirmation_required' ELSE 'verification_required' END"""


@query("f19_utility", f"""
WITH p AS (SELECT *, CASE WHEN id % 9 = 0 THEN TIMESTAMP '2024-01-01' WHEN id % 9 = 1 THEN TIMESTAMP '2024-06-01' END AS expires FROM s_points)
SELECT id, {UTILITY_SQL.replace("{supp}", "is_suppressed").replace("{conf}", "manually_confirmed").replace("{stale}", f"expires < TIMESTAMP '{EVENTS_AS_OF}'")} AS utility FROM p
""")
def f19(t):
    expires = F.when(F.col("id") % 9 == 0, F.lit("2024-01-01")).when(F.col("id") % 9 == 1, F.lit("2024-06-01")).cast("timestamp_ntz")
    state = utility.derive_utility(
        F.col("kind"), F.col("publication_state"), F.col("deliverability_state"), F.col("person_match_state"), F.col("is_suppressed"),
        F.col("manually_confirmed"), expires, F.lit(EVENTS_AS_OF).cast("timestamp_ntz"),
    )
    return t.s_points.select("id", state.alias("utility"))


@query("f20_usable_and_review", """
SELECT id, utility_state IN ('usable_personal', 'usable_role', 'usable_generic') AS usable,
  utility_state IN ('manual_confirmation_required', 'verification_required', 'stale') AS review FROM s_points
""")
def f20(t):
    state = F.col("utility_state")
    return t.s_points.select("id", utility.is_usable(state).alias("usable"), utility.needs_review(state).alias("review"))


_PRIORITY_CASES = " ".join(f"WHEN contains(h, '{term}') THEN {i}" for i, term in enumerate(fixed.PAGE_PRIORITY_TERMS))


@query("f21_page_priority", f"""
WITH f AS (SELECT page_id, lower(strip_accents(url || ' ')) AS h FROM s_site_pages) SELECT page_id, CASE {_PRIORITY_CASES} ELSE 100 END AS priority FROM f
""", whole="priority")
def f21(t):
    return t.s_site_pages.select("page_id", text.page_priority(F.col("url"), F.lit("")).alias("priority"))


@query("f22_technicians", """
WITH b AS (SELECT id, CASE id % 7 WHEN 0 THEN '1-10' WHEN 1 THEN '11-50' WHEN 2 THEN '10-49' WHEN 3 THEN '51-200' WHEN 4 THEN '50-199' WHEN 5 THEN 'n/a' END AS band,
  id % 3 = 0 AS branches, CASE WHEN id % 4 = 0 THEN id % 60 ELSE 0 END AS found FROM s_prospects),
r AS (SELECT *, CASE WHEN contains(band, '1-10') OR contains(band, '1-5') THEN 5 WHEN contains(band, '11-50') OR contains(band, '10-49') THEN 12
    WHEN contains(band, '51-200') OR contains(band, '50-199') THEN 35 ELSE 10 END AS lo,
  CASE WHEN contains(band, '1-10') OR contains(band, '1-5') THEN 12 WHEN contains(band, '11-50') OR contains(band, '10-49') THEN 45
    WHEN contains(band, '51-200') OR contains(band, '50-199') THEN 120 ELSE 50 END AS high FROM b),
s AS (SELECT *, CASE WHEN branches THEN greatest(lo, 15) ELSE lo END AS low FROM r)
SELECT id, low, high, CASE WHEN found > 0 THEN greatest(found, low + 5) ELSE (low + high) // 2 END AS point FROM s
""", whole="low high point")
def f22(t):
    k = F.col("id")
    band = F.element_at(F.array(*[F.lit(b) for b in ("1-10", "11-50", "10-49", "51-200", "50-199", "n/a", None)]), (k % 7 + 1).cast("int"))
    found_codes = F.when(k % 3 == 0, F.array(F.lit(fixed.MULTI_BRANCH))).otherwise(F.array().cast("array<string>"))
    out = t.s_prospects.select("id", codes.estimate_technicians(band, found_codes, F.when(k % 4 == 0, k % 60).otherwise(0)).alias("e"))
    return out.select("id", "e.low", "e.high", "e.point")


_TITLES = pick("o_orderkey", "Managing Director", "Head of Operations", "Service Manager", "Contracts Manager", "Technical Director", "Branch Manager", "Clerk",
               "Gérant", "Directeur des opérations", "Responsable SAV", "Directeur technique", "Chef d'équipe", "Secrétaire")


@query("f23_buyer_role", f"""
WITH o AS (SELECT o_orderkey, lower({_TITLES}) AS w, CASE WHEN o_orderkey % 2 = 0 THEN 'GB' ELSE 'FR' END AS j FROM orders)
SELECT o_orderkey, CASE {" ".join(f"WHEN j = 'GB' AND regexp_matches(w, '{p}') THEN '{r}'" for p, r, _, _ in fixed.BUYER_ROLES_GB)}
  {" ".join("WHEN j = 'FR' AND regexp_matches(w, '" + p.replace("'", "''") + f"') THEN '{r}'" for p, r, _, _ in fixed.BUYER_ROLES_FR)} ELSE 'OTHER_EXECUTIVE' END AS role FROM o
""")
def f23(t):
    place = F.when(F.col("o_orderkey") % 2 == 0, "GB").otherwise("FR")
    return t.orders.select("o_orderkey", codes.buyer_role(F.expr(_TITLES), place)["role"].alias("role"))


def _taxonomy_sql(code: str, words: tuple[str, ...]) -> str:
    q = [w.replace("'", "''") for w in words]
    word = "CASE " + " ".join(f"WHEN regexp_matches(lower(html), '{w}') THEN '{w}'" for w in q) + " END"
    return f"SELECT page_id, '{code}' AS code, {word} AS word FROM s_site_pages"


@query("f24_page_evidence", f"""
SELECT page_id, code, word IS NOT NULL AS found FROM ({" UNION ALL ".join(_taxonomy_sql(code, words) for code, _, _, words in fixed.EVIDENCE_TAXONOMY)}) x WHERE word IS NOT NULL
""")
def f24(t):
    out = evidence.extract_evidence(t.s_site_pages, "html")
    return out.select("page_id", "code", (F.length("evidence_text") > 0).alias("found"))


def _snippet_sql(code: str, label: str, words) -> str:
    """The text around the first hit of the first keyword found, over rows ``page_id, x, l``."""
    quoted = [w.replace("'", "''") for w in words]
    ahead = " ".join(f"WHEN regexp_matches(l, '{w}') THEN length(regexp_extract(l, '(?s)^(.*?)(?:{w})', 1))" for w in quoted)
    size = " ".join(f"WHEN regexp_matches(l, '{w}') THEN length(regexp_extract(l, '{w}'))" for w in quoted)
    return f"SELECT page_id, '{code}' AS code, '{label}' AS label, x, CASE {ahead} END AS ahead, CASE {size} END AS size FROM seen"


@query("f24c_all_snippets", f"""
WITH seen AS (SELECT page_id, html AS x, lower(html) AS l FROM s_site_pages),
hits AS ({" UNION ALL ".join(_snippet_sql(code, label, words) for code, _, label, words in fixed.EVIDENCE_TAXONOMY)})
SELECT page_id, code, '[' || label || '] Snippet: ...' || regexp_replace(substring(x, greatest(ahead - 40, 0) + 1, ahead + size + 60 - greatest(ahead - 40, 0)), '^\\s+|\\s+$', '', 'g') || '...' AS evidence_text
FROM hits WHERE ahead IS NOT NULL
""")
def f24c(t):
    return evidence.extract_evidence(t.s_site_pages, "html").select("page_id", "code", "evidence_text")


@query("f24b_evidence_snippets", r"""
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || ' Service 24/7 garanti ' || text WHEN 1 THEN 'Astreinte ' || text ELSE text END AS x FROM documents),
h AS (SELECT doc_id, x, instr(lower(x), '24/7') AS a, instr(lower(x), 'astreinte') AS b FROM d)
SELECT doc_id, '[24/7 emergency callout or on-call service] Snippet: ...' || regexp_replace(
  CASE WHEN a > 0 THEN substring(x, greatest(a - 40, 1), a + 3 + 60 - greatest(a - 40, 1) + 1) ELSE substring(x, greatest(b - 40, 1), b + 8 + 60 - greatest(b - 40, 1) + 1) END, '^\s+|\s+$', '', 'g') || '...' AS evidence_text
FROM h WHERE a > 0 OR b > 0
""")
def f24b(t):
    k, body = F.col("doc_id"), F.col("text")
    texts = t.documents.select(
        "doc_id",
        F.when(k % 3 == 0, F.concat(body, F.lit(" Service 24/7 garanti "), body)).when(k % 3 == 1, F.concat(F.lit("Astreinte "), body)).otherwise(body).alias("text"),
    )
    out = evidence.extract_evidence(texts).filter(F.col("code") == fixed.ON_CALL)
    return out.select("doc_id", "evidence_text")


@query("f25_contact_status", """
SELECT id, CASE WHEN lower(contact_confidence) IN ('confirmed_by_reply', 'published_personal', 'deliverable', 'verified') THEN 'Usable contact'
  WHEN lower(contact_confidence) IN ('catch_all', 'indeterminate') OR lower(contact_discovery_state) = 'guessed' THEN 'Guessed / risky — review'
  WHEN email IS NOT NULL AND lower(contact_confidence) IN ('likely', 'published_generic', 'unverified') THEN 'Email candidate'
  WHEN needs_manual_review OR lower(contact_confidence) IN ('needs_review', 'none') THEN 'Needs review' ELSE 'No email yet' END AS status FROM s_prospects
""")
def f25(t):
    status = codes.contact_status(F.col("contact_confidence"), F.col("contact_discovery_state"), F.col("email"), F.col("needs_manual_review"))
    return t.s_prospects.select("id", status.alias("status"))


@query("f26_badges_and_rank", """
SELECT id, concat_ws('|', CASE WHEN signal_type IN ('DECP_WIN', 'BOAMP_WIN', 'PUBLIC_AWARD') THEN 'Public award' END, CASE WHEN signal_type = 'REGISTRY_FIELD' THEN 'Field registry' END,
    CASE WHEN id % 5 >= 2 THEN CAST(id % 5 AS VARCHAR) || ' awards' END, CASE WHEN company_size IN ('11-50', '51-200') THEN 'SME fit' END,
    CASE WHEN decision_maker_name IS NOT NULL THEN 'Person named' END, CASE readiness_state WHEN 'contact_ready' THEN 'Meeting-ready' WHEN 'human_review_required' THEN 'Needs human OK' END) AS badges,
  concat_ws('|', why_now, suspected_pain) AS why,
  CASE WHEN opportunity_score <> 0 THEN opportunity_score WHEN acquisition_score <> 0 THEN acquisition_score ELSE urgency_score END AS rank FROM s_prospects
""", whole="rank")
def f26(t):
    none = F.lit(None).cast("array<string>")
    badge = codes.badges(none, F.col("signal_type"), F.col("id") % 5, F.col("company_size"), F.col("decision_maker_name"), F.col("readiness_state"))
    return t.s_prospects.select(
        "id", F.array_join(badge, "|").alias("badges"),
        F.array_join(codes.why_this_lead(none, F.col("why_now"), F.col("suspected_pain")), "|").alias("why"),
        codes.primary_rank(F.col("opportunity_score"), F.col("acquisition_score"), F.col("urgency_score")).alias("rank"),
    )


@query("f27_people_search", """
SELECT id, 'https://www.google.com/search?q=' || url_encode('site:linkedin.com/in "' || company_name || '"' || coalesce(' "' || decision_maker_name || '"', '') || coalesce(' ' || decision_maker_title, '')) AS url
FROM s_prospects
""")
def f27(t):
    url = text.people_search_url(F.col("company_name"), F.col("decision_maker_name"), F.col("decision_maker_title"))
    return t.s_prospects.select("id", F.replace(url, F.lit("linkedin.com/in"), F.lit("linkedin.com%2Fin")).alias("url"))


@query("f28_outreach_drafts")
def f28(t):
    from leadloom.catalog.jobs import award_lists

    rows = mark_suppressed(t.s_prospects, t.s_suppression).join(award_lists(t), "id", "left")
    out = drafts.with_drafts(rows)
    return out.select("id", "linkedin_connection_note", "linkedin_first_message", "email_subject", "email_body")


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _local_body(name: str) -> str:
    quotes = f"coalesce({_sql(chr(10) * 2 + fixed.LOCAL_QUOTES[name])} || bullets, '')"
    buyer = f"coalesce(nullif(trim(decision_maker_name), ''), {_sql(fixed.LOCAL_NOBODY[name])})"
    return (f"replace(replace(replace(replace({_sql(fixed.LOCAL_BODIES[name])}, '{{sender}}', 'Sam'), '{{company}}', company_name), '{{quotes}}', {quotes}), "
            f"'{{buyer}}', {buyer})")


@query("f29_localised_drafts", f"""
WITH shown AS (SELECT prospect_id, id, evidence_text, row_number() OVER (PARTITION BY prospect_id ORDER BY id) AS rn FROM s_evidence WHERE is_active),
c AS (SELECT prospect_id, string_agg(chr(10) || '- ' || evidence_text, '' ORDER BY id) AS bullets FROM shown WHERE rn <= 2 AND trim(coalesce(evidence_text, '')) <> '' GROUP BY 1)
SELECT p.id, replace(CASE WHEN p.id % 2 = 0 THEN {_sql(fixed.LOCAL_SUBJECTS["en-GB"])} ELSE {_sql(fixed.LOCAL_SUBJECTS["fr-FR"])} END, '{{company}}', company_name) AS subject,
  CASE WHEN p.id % 2 = 0 THEN {_local_body("en-GB")} ELSE {_local_body("fr-FR")} END AS body, 'draft_pending' AS approval_status
FROM s_prospects p LEFT JOIN c ON c.prospect_id = p.id
""")
def f29(t):
    items = evidence.evidence_lists(t.s_evidence, keep=2).select(
        F.col("prospect_id").alias("id"), F.transform("evidence_json", lambda e: e["evidence_text"]).alias("citations")
    )
    rows = t.s_prospects.withColumns(
        {"buyer_name": F.col("decision_maker_name"), "locale": F.when(F.col("id") % 2 == 0, "en-GB").otherwise("fr-FR")}
    ).join(items, "id", "left")
    return drafts.localised_drafts(rows, "Sam", citations=2).select("id", "subject", "body", "approval_status")


@query("f30_website_candidates", r"""
WITH b AS (SELECT id, regexp_replace(regexp_replace(replace(lower(company_name), 'société ', ' '), '\b(sas|sarl|sa|eurl|sci|sasu|snc|ste|société|societe)\b', '', 'g'), '[^a-z0-9]+', '', 'g') AS b FROM s_prospects)
SELECT id, CASE WHEN length(b) >= 3 THEN 'https://www.' || b || '.fr https://' || b || '.fr https://www.' || b || '.com https://' || b || '.com' END AS urls FROM b
""")
def f30(t):
    return t.s_prospects.select("id", F.array_join(text.website_candidates(F.col("company_name")), " ").alias("urls"))


_PAYLOAD = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN '{{"is_reachable":"safe","smtp":{{"is_deliverable":true,"is_catch_all":false}}}}' WHEN 1 THEN '{{"is_reachable":"safe","smtp":{{"is_deliverable":true,"is_catch_all":true}}}}'
  WHEN 2 THEN '{{"is_reachable":"Risky"}}' WHEN 3 THEN '{{"is_reachable":"invalid","smtp":{{"is_deliverable":false}}}}' WHEN 4 THEN '{{"syntax":{{"is_valid_syntax":false}}}}' WHEN 5 THEN '{{"mx":{{"accepts_mail":true}}}}' ELSE '{{}}' END AS payload FROM """


@query("f31_verdicts", """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'deliverable' WHEN 1 THEN 'catch_all' WHEN 2 THEN 'risky' WHEN 3 THEN 'invalid' WHEN 4 THEN 'invalid' ELSE 'indeterminate' END AS confidence,
  CASE event_id % 7 WHEN 0 THEN 'deliverable' WHEN 1 THEN 'deliverable' WHEN 3 THEN 'not_deliverable' ELSE 'unknown' END AS smtp_state,
  CASE WHEN event_id % 7 = 5 THEN 'valid' ELSE 'unknown' END AS mx_state FROM events
""")
def f31(t):
    raw = t.spark.sql(_PAYLOAD + "{events}", events=t.events)
    out = raw.select("event_id", utility.normalise_verdict(F.col("payload")).alias("v"))
    return out.select("event_id", "v.confidence", "v.smtp_state", "v.mx_state")


@query("f32_mx_states", f"""
WITH j AS (SELECT p.*, m.state, m.has_mx, m.domain IS NOT NULL AND p.kind = 'email' AND p.deliverability_state = 'unchecked' AS checked
  FROM s_points p LEFT JOIN s_mx m ON m.domain = p.domain),
s AS (SELECT * REPLACE (CASE WHEN NOT checked OR has_mx THEN deliverability_state WHEN state IN ('no_mx', 'null_mx', 'invalid_syntax') THEN 'invalid' ELSE 'indeterminate' END AS deliverability_state) FROM j)
SELECT id, deliverability_state, CASE WHEN checked AND NOT has_mx THEN {UTILITY_SQL.replace("{supp}", "FALSE").replace("{conf}", "FALSE").replace("{stale}", "FALSE")} ELSE utility_state END AS utility_state FROM s
""")
def f32(t):
    return contacts.apply_mx(t.s_points, t.s_mx).select("id", "deliverability_state", "utility_state")


@query("f33_waterfall_outcome", """
WITH w AS (SELECT id, email, CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'deliverable' WHEN 2 THEN 'verified' WHEN 3 THEN 'catch_all' WHEN 4 THEN 'risky' WHEN 5 THEN '' ELSE 'indeterminate' END AS c,
  CASE WHEN id % 3 = 0 THEN 'h@x.fr' WHEN id % 3 = 1 THEN email END AS h FROM s_prospects),
b AS (SELECT id, CASE WHEN id % 7 = 0 THEN h ELSE coalesce(email, h) END AS best, CASE WHEN id % 7 = 0 OR email IS NULL THEN CASE WHEN h IS NOT NULL THEN 'unverified' END ELSE nullif(c, '') END AS v, h FROM w)
SELECT id, best, CASE WHEN best IS NULL THEN 'none' WHEN v IN ('deliverable', 'verified', 'catch_all') THEN 'reacher' WHEN best = h THEN 'theharvester' ELSE 'reacher' END AS source,
  CASE WHEN best IS NULL THEN 'needs_review' WHEN v IN ('deliverable', 'verified', 'catch_all') THEN v WHEN best = h THEN coalesce(v, 'unverified') ELSE coalesce(v, 'domain_and_pattern_only') END AS confidence FROM b
""")
def f33(t):
    k = F.col("id")
    states = F.array(*[F.lit(s) for s in (None, "deliverable", "verified", "catch_all", "risky", "", "indeterminate")])
    harvested = F.when(k % 3 == 0, F.array(F.lit("h@x.fr"))).when((k % 3 == 1) & F.col("email").isNotNull(), F.array("email"))
    best = F.when(k % 7 != 0, F.col("email"))
    state = F.when(best.isNotNull(), F.element_at(states, (k % 7 + 1).cast("int")))
    out = t.s_prospects.select("id", utility.waterfall_outcome(best, state, harvested).alias("o"))
    return out.select("id", F.col("o.email").alias("best"), "o.source", "o.confidence")


@query("f34_priority_label", """
SELECT id, CASE WHEN urgency_score >= 70 THEN 'High' WHEN urgency_score >= 45 THEN 'Medium' ELSE 'Low' END AS v3,
  CASE WHEN urgency_score >= 75 THEN 'High' WHEN urgency_score >= 45 THEN 'Medium' ELSE 'Low' END AS v2 FROM s_prospects
""")
def f34(t):
    score = F.col("urgency_score")
    return t.s_prospects.select("id", codes.priority_label(score).alias("v3"), codes.priority_label(score, 2).alias("v2"))


