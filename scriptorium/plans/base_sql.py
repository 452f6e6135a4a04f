"""The wiki's tables in SQL, for the queries' SQL counterparts."""

PAGES = """w_pages AS (
  SELECT o_orderkey AS page_id, lower(o_orderstatus) AS category,
    CASE WHEN o_orderkey % 97 = 0 THEN '_' ELSE '' END || 'order-' || o_orderkey AS name,
    lower(o_orderstatus) || ':' || CASE WHEN o_orderkey % 97 = 0 THEN '_' ELSE '' END || 'order-' || o_orderkey AS fullname,
    CASE WHEN o_orderkey % 50 = 0 THEN CASE WHEN o_orderkey % 97 = 0 THEN '_' ELSE '' END || 'order-' || o_orderkey
      ELSE 'Order ' || o_orderkey END AS title,
    o_orderdate AS created_at, o_orderdate + to_days(CAST(o_orderkey % 90 AS INTEGER)) AS updated_at,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) END AS commented_at,
    o_custkey AS owner_id, o_custkey + o_orderkey % 2 AS editor_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey + o_orderkey % 5 END AS commenter_id, CASE WHEN o_orderkey > 0 THEN o_orderkey // 8 END AS parent_id,
    CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderkey % 5 AS comments, o_orderkey % 11 AS revisions, o_orderpriority AS priority
  FROM orders)"""
TAGS = """w_tags AS (
  SELECT DISTINCT l_orderkey AS page_id, unnest(['flag-' || lower(l_returnflag), 'status-' || lower(l_linestatus),
    CASE WHEN l_quantity >= 49 THEN '_bulk' END]) AS tag FROM lineitem), w_tag_rows AS (SELECT * FROM w_tags WHERE tag IS NOT NULL),
w_lists AS (
  SELECT page_id, list_sort(list(tag) FILTER (NOT starts_with(tag, '_'))) AS tags, list_sort(list(tag) FILTER (starts_with(tag, '_'))) AS hidden_tags,
    list(tag) AS every FROM w_tag_rows GROUP BY page_id)"""
USERS = "w_users AS (SELECT c_custkey AS user_id, c_name AS name, regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') AS unix_name FROM customer)"
VOTES = """w_events AS (
  SELECT event_id AS vote_id, user_id, event_id % 1000 AS page_id, event_type AS axis_key,
    CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS rate, ts FROM events),
w_votes AS (
  SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, page_id ORDER BY ts DESC, vote_id DESC) AS place FROM w_events) WHERE place = 1),
w_ratings AS (
  SELECT page_id, CAST(sum(rate) AS BIGINT) AS rating, count(*) AS rating_votes, count(*) FILTER (rate > 0) AS positive,
    CAST(floor(count(*) FILTER (rate > 0) / count(*) * 100 + 0.5) AS BIGINT) AS rating_percent FROM w_votes GROUP BY page_id)"""
AXES = """w_axes(axis_key, label, allow_up, allow_neutral, allow_down, can_vote, can_cancel, enabled, show_aggregate) AS (VALUES
  ('click', 'Clarity', true, true, true, true, true, true, true), ('purchase', 'Value', true, false, false, true, false, true, true),
  ('error', 'Faults', false, true, true, true, true, true, false), ('view', 'Reach', true, true, false, false, true, true, true),
  ('signup', 'Growth', true, true, true, true, true, false, true))"""
ALLOWED = "CASE WHEN rate > 0 THEN allow_up WHEN rate < 0 THEN allow_down ELSE allow_neutral END"
ALLOWED_VOTES = f"""w_open AS (
  SELECT * EXCLUDE (place) FROM (SELECT e.*, row_number() OVER (PARTITION BY user_id, page_id, axis_key ORDER BY ts DESC, vote_id DESC) AS place
    FROM w_events e JOIN w_axes USING (axis_key) WHERE enabled AND can_vote AND {ALLOWED}) WHERE place = 1)"""
LINKS = """w_hrefs AS (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1, 'i') AS h FROM pages),
w_links AS (SELECT page_id, CAST(unnest(range(len(h))) AS INTEGER) AS ord, unnest(h) AS target FROM w_hrefs)"""
TEXTS = """w_labels AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
w_texts AS (
  SELECT d.doc_id AS page_id, source || ':doc-' || d.doc_id AS fullname, text AS source_text,
    list_filter([lang, CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN '_toxic' END], lambda t: t IS NOT NULL) AS tags
  FROM documents d LEFT JOIN w_labels USING (doc_id))"""


def sql(*tables: str, body: str) -> str:
    return f"WITH {', '.join(tables)} {body}"
