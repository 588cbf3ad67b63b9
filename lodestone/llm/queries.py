"""The registered queries of the training-data operators. None is expressible in SQL; tests/llm holds brute-force versions."""

from . import htmltext, images, mixing, multiindex, neardup, packing, secret_scan, sstable, toxicity, urlrules

QUERIES = {
    f.__name__: f
    for f in (
        sstable.op1_sstable,
        htmltext.op2_template_extraction,
        urlrules.op3_url_rules,
        secret_scan.op4_secret_automaton,
        multiindex.op5_multi_index,
        packing.op6_harmonic_packing,
        mixing.op7_systematic_mix,
        images.op8_image_copies,
        neardup.op9_minmax_hash,
        toxicity.op10_toxicity_ordinal,
    )
}
ORACLE_SQL: dict[str, str] = {}
