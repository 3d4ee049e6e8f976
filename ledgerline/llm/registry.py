"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from ledgerline.llm.bpe_codec import op5_bpe_codec
from ledgerline.llm.chat_windows import op2_chat_windows
from ledgerline.llm.decontaminate import op7_decontaminate
from ledgerline.llm.html_crf import op11_html_crf
from ledgerline.llm.importance import op13_importance
from ledgerline.llm.jaccard_trees import op3_jaccard_trees
from ledgerline.llm.license_scan import op9_license_scan
from ledgerline.llm.merkle_manifest import op12_merkle_manifest
from ledgerline.llm.packed_ids import op1_packed_ids
from ledgerline.llm.quality_pu import op8_quality_pu
from ledgerline.llm.repeated_passages import op10_repeated_passages
from ledgerline.llm.secrets_crf import op6_secrets_crf
from ledgerline.llm.sql import JACCARD_CLASSES, MERKLE, RESAMPLED
from ledgerline.llm.syncmers import op4_syncmers


def queries() -> dict:
    return {
        "op1_packed_ids": op1_packed_ids,
        "op2_chat_windows": op2_chat_windows,
        "op3_jaccard_trees": op3_jaccard_trees,
        "op4_syncmers": op4_syncmers,
        "op5_bpe_codec": op5_bpe_codec,
        "op6_secrets_crf": op6_secrets_crf,
        "op7_decontaminate": op7_decontaminate,
        "op8_quality_pu": op8_quality_pu,
        "op9_license_scan": op9_license_scan,
        "op10_repeated_passages": op10_repeated_passages,
        "op11_html_crf": op11_html_crf,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_importance": op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_trees": JACCARD_CLASSES, "op12_merkle_manifest": MERKLE, "op13_importance": RESAMPLED}
