"""The core's data problems: changes between snapshots and results for skewed keys."""

from __future__ import annotations

from corvane.operators.skew import first_per_key, rank_per_key
from corvane.operators.snapshots import snapshot_changes
from corvane.plans.registry import Registry
from corvane.session import table

registry = Registry()


@registry.query(
    "p2_found",
    sql=r"""
    WITH normal AS (
      SELECT release_no, variation_id, loaded_at,
             nullif(trim(regexp_replace(lower(clinical_significance), '\s+', ' ', 'g')), '') AS s,
             nullif(trim(regexp_replace(lower(review_status), '\s+', ' ', 'g')), '') AS r
      FROM variant_snapshots),
    cur AS (
      SELECT * FROM normal
      QUALIFY row_number() OVER (PARTITION BY release_no, variation_id
                                 ORDER BY loaded_at DESC NULLS LAST, s DESC NULLS LAST, r DESC NULLS LAST) = 1),
    rel AS (SELECT release_no, lead(release_no) OVER (ORDER BY release_no) AS later FROM (SELECT DISTINCT release_no FROM cur)),
    old AS (SELECT later AS release_no, variation_id, s, r FROM cur JOIN rel USING (release_no) WHERE later IS NOT NULL),
    new AS (SELECT cur.* FROM cur WHERE release_no > (SELECT min(release_no) FROM rel))
    SELECT coalesce(new.release_no, old.release_no) AS release_no, coalesce(new.variation_id, old.variation_id) AS variation_id,
           CASE WHEN old.variation_id IS NULL THEN 'added' WHEN new.variation_id IS NULL THEN 'removed' ELSE 'changed' END AS change_type
    FROM new FULL JOIN old ON new.release_no = old.release_no AND new.variation_id = old.variation_id
    WHERE old.variation_id IS NULL OR new.variation_id IS NULL OR new.s IS DISTINCT FROM old.s OR new.r IS DISTINCT FROM old.r
    """,
)
def p2_found(spark, sf_dir):
    return snapshot_changes(
        table(spark, sf_dir, "variant_snapshots"), "release_no", "variation_id", ["clinical_significance", "review_status"], loaded="loaded_at"
    )


@registry.query(
    "p4_found",
    sql="""
    SELECT gene, variation_id FROM (SELECT gene, variation_id, min(created_at) AS o FROM variants WHERE trim(gene) <> '' GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY gene ORDER BY o, variation_id) <= 3
    """,
)
def p4_found(spark, sf_dir):
    return first_per_key(table(spark, sf_dir, "variants"), "gene", "variation_id", "created_at", n=3)


@registry.query(
    "p4_rank",
    sql="SELECT id, gene, row_number() OVER (PARTITION BY gene ORDER BY created_at, id, updated_at, review_status NULLS FIRST) AS place FROM variants",
)
def p4_rank(spark, sf_dir):
    """Every row's place within its gene, the other kind of per-key result: nothing is cut off."""
    rows = table(spark, sf_dir, "variants").select("id", "gene", "created_at", "updated_at", "review_status")
    return rank_per_key(rows, "gene", ["created_at", "id", "updated_at", "review_status"], "place").select("id", "gene", "place")
