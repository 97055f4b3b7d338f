"""Queries of this subpackage and their DuckDB SQL."""

from docloom.llm import chat, decontaminate, fingerprints, langid, mixing, secrets, simhash, substrings, urls, warc

QUERIES = {
    f.__name__: f
    for f in (
        chat.op1_chat_format,
        secrets.op2_secret_scan,
        langid.op3_language_id,
        urls.op4_url_filter,
        decontaminate.op5_decontamination,
        fingerprints.op6_document_fingerprint,
        simhash.op7_simhash_dedup,
        substrings.op8_substring_dedup,
        warc.op9_warc_archive,
        mixing.op10_source_mix,
    )
}

ORACLES = {
    "op1_chat_format": chat.OP1_SQL,
    "op4_url_filter": urls.OP4_SQL,
    "op5_decontamination": decontaminate.OP5_SQL,
    "op8_substring_dedup": substrings.OP8_SQL,
    "op9_warc_archive": warc.OP9_SQL,
    "op10_source_mix": mixing.OP10_SQL,
}
