"""The CRM views of ``dealgrid.sources.crm`` written independently as DuckDB SQL.

Used only by the oracle texts: every oracle query is ``WITH <these views> <query>``.
"""

CRM_CTES = """
reps AS (
  SELECT 'REP' || s.s_suppkey AS rep_id, s.s_name AS name,
         DATE '1990-01-01' + CAST((s.s_suppkey * 37) % 1460 AS INTEGER) AS hire_date,
         r.r_name AS territory,
         CAST(800000 + (s.s_suppkey * 7919) % 700000 AS INTEGER) AS annual_quota
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey
),
lead_base AS (
  SELECT o.o_orderkey AS k, c.c_name, o.o_orderstatus, CAST(o.o_orderdate AS DATE) AS created_at,
         o.o_totalprice,
         CASE left(o.o_orderpriority, 1) WHEN '1' THEN 'referral' WHEN '2' THEN 'event'
              WHEN '3' THEN 'organic' WHEN '4' THEN 'outbound' WHEN '5' THEN 'paid_search' END AS source,
         CASE WHEN c.c_custkey % 10 < 2 THEN '1-10' WHEN c.c_custkey % 10 < 5 THEN '11-50'
              WHEN c.c_custkey % 10 < 8 THEN '51-200' ELSE '201-1000' END AS company_size,
         CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'pharma' WHEN 'BUILDING' THEN 'biotech'
              WHEN 'FURNITURE' THEN 'medical_devices' WHEN 'HOUSEHOLD' THEN 'cro'
              WHEN 'MACHINERY' THEN 'research_university' END AS industry
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
),
leads_k AS (
  SELECT *, (k * 37) % 100 < CASE source WHEN 'referral' THEN 80 WHEN 'event' THEN 70
         WHEN 'organic' THEN 50 WHEN 'outbound' THEN 40 WHEN 'paid_search' THEN 30 END AS converted
  FROM lead_base
),
leads AS (
  SELECT 'LEAD' || k AS lead_id, source, created_at, company_size, industry, converted,
         CASE WHEN converted THEN created_at + CAST(7 + k % 53 AS INTEGER) END AS converted_at,
         CASE WHEN converted THEN CAST(floor(o_totalprice) AS INTEGER) END AS conversion_value
  FROM leads_k
),
deals_k AS (
  SELECT 'DEAL' || k AS deal_id, 'LEAD' || k AS lead_id,
         'REP' || (k % (SELECT count(*) FROM supplier)) AS rep_id,
         CASE k % 5 WHEN 0 THEN 'LIMS Software' WHEN 1 THEN 'Lab Automation Platform'
              WHEN 2 THEN 'Genomic Sequencing Tools' WHEN 3 THEN 'Clinical Trial Management Software'
              ELSE 'Reagent Supply Contract' END AS product,
         CASE WHEN o_orderstatus = 'F' THEN 'closed_won' WHEN o_orderstatus = 'P' THEN 'closed_lost'
              ELSE CASE k % 4 WHEN 0 THEN 'prospecting' WHEN 1 THEN 'discovery' WHEN 2 THEN 'proposal'
                   ELSE 'negotiation' END END AS stage,
         created_at + CAST(7 + k % 53 AS INTEGER) AS created_at,
         created_at + CAST(7 + k % 53 AS INTEGER) + CAST((k * 13) % (7 + k % 84) AS INTEGER) AS last_contact_date,
         CASE WHEN o_orderstatus <> 'O' THEN created_at + CAST(7 + k % 53 AS INTEGER) + CAST(7 + k % 84 AS INTEGER) END AS close_date,
         CAST(floor(o_totalprice) AS INTEGER) AS value,
         CASE o_orderstatus WHEN 'F' THEN 'closed_won' WHEN 'P' THEN 'closed_lost' WHEN 'O' THEN 'open' END AS outcome,
         k, c_name, company_size
  FROM leads_k WHERE converted
),
deals AS (
  SELECT deal_id, lead_id, rep_id, product, stage, created_at, last_contact_date, close_date, value, outcome
  FROM deals_k
),
engagement_base AS (
  SELECT 'EVT' || l.l_orderkey || '-' || l.l_linenumber || '-' || l.l_partkey AS event_id,
         d.deal_id,
         CASE WHEN (l.l_partkey + l.l_linenumber) % 10 < 4 THEN 'email_sent'
              WHEN (l.l_partkey + l.l_linenumber) % 10 < 6 THEN 'email_reply'
              WHEN (l.l_partkey + l.l_linenumber) % 10 < 8 THEN 'call' ELSE 'meeting' END AS event_type,
         d.created_at + CAST(l.l_partkey % (1 + datediff('day', d.created_at, coalesce(d.close_date, d.last_contact_date))) AS INTEGER) AS ts_clean,
         CAST(l.l_shipdate AS DATE) AS ts_raw,
         l.l_partkey
  FROM lineitem l JOIN deals_k d ON l.l_orderkey = d.k
),
engagement AS (
  SELECT event_id, deal_id, event_type, ts_clean AS "timestamp",
         CASE WHEN event_type IN ('email_sent', 'email_reply') THEN 'email' WHEN event_type = 'call' THEN 'phone'
              WHEN l_partkey % 4 = 0 THEN 'in_person' ELSE 'zoom' END AS channel
  FROM engagement_base
),
engagement_raw AS (
  SELECT event_id, deal_id, event_type, ts_raw AS "timestamp",
         CASE WHEN event_type IN ('email_sent', 'email_reply') THEN 'email' WHEN event_type = 'call' THEN 'phone'
              WHEN l_partkey % 4 = 0 THEN 'in_person' ELSE 'zoom' END AS channel
  FROM engagement_base
),
customers AS (
  SELECT 'CUST' || k AS customer_id, c_name AS company_name, tier AS subscription_tier,
         CAST(CASE tier WHEN 'starter' THEN 1800 + k % 701 WHEN 'growth' THEN 5000 + k % 2501
              ELSE 12000 + k % 6001 END AS INTEGER) AS mrr,
         close_date AS start_date,
         CASE WHEN churned THEN CAST(close_date + to_months(CAST(1 + k % 36 AS INTEGER)) AS DATE) END AS churn_date,
         CASE WHEN churned THEN CASE k % 4 WHEN 0 THEN 'price' WHEN 1 THEN 'product_fit'
              WHEN 2 THEN 'competition' ELSE 'went_dark' END END AS churn_reason
  FROM (
    SELECT *, (k * 17) % 100 < CASE tier WHEN 'starter' THEN 45 WHEN 'growth' THEN 25 ELSE 15 END AS churned
    FROM (SELECT *, CASE WHEN company_size IN ('1-10', '11-50') THEN 'starter'
                         WHEN company_size = '51-200' THEN 'growth' ELSE 'enterprise' END AS tier
          FROM deals_k WHERE outcome = 'closed_won')
  )
),
insights AS (
  SELECT CAST(event_id AS BIGINT) AS id, ts AS generated_at,
         CASE event_type WHEN 'view' THEN 'mrr' WHEN 'click' THEN 'churn' WHEN 'purchase' THEN 'pipeline'
              WHEN 'signup' THEN 'leads' WHEN 'error' THEN 'deals' END AS insight_type,
         props AS summary, props AS data_snapshot
  FROM events
)
"""


def with_crm(query: str) -> str:
    return "WITH " + CRM_CTES.strip() + "\n" + query.strip()
