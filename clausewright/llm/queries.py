"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from clausewright.llm.encode import p8_covered, p8_decoded, p8_ids
from clausewright.llm.encoding import p1_found, p1_restored
from clausewright.llm.leaks import p9_found, p9_longest, p9_tiles
from clausewright.llm.lookalikes import p7_found, p7_residue, p7_unified
from clausewright.llm.near_copies import p6_first, p6_found, p6_groups
from clausewright.llm.personal import p2_found, p2_masked
from clausewright.llm.quality import p10_counts, p10_found, p10_statistics
from clausewright.llm.scan_noise import p5_found, p5_repaired
from clausewright.llm.sentence_bounds import p4_found
from clausewright.llm.split_items import p3_found
from clausewright.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]

QUERIES = {
    "p1_found": p1_found,
    "p1_restored": p1_restored,
    "p2_found": p2_found,
    "p2_masked": p2_masked,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_repaired": p5_repaired,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p6_first": p6_first,
    "p7_found": p7_found,
    "p7_unified": p7_unified,
    "p7_residue": p7_residue,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p8_covered": p8_covered,
    "p9_found": p9_found,
    "p9_longest": p9_longest,
    "p9_tiles": p9_tiles,
    "p10_counts": p10_counts,
    "p10_found": p10_found,
    "p10_statistics": p10_statistics,
}
