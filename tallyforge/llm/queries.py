"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import ann, chat, hmm, mixing, pieces, quality, secrets, simhash, suffix, warc

QUERIES = {"op1_ann": ann.op1_ann, "op2_hmm": hmm.op2_hmm, "op3_mix": mixing.op3_mix, "op4_warc": warc.op4_warc, "op5_quality": quality.op5_quality, "op6_simhash": simhash.op6_simhash, "op7_pieces": pieces.op7_pieces, "op8_chat": chat.op8_chat, "op9_secrets": secrets.op9_secrets, "op10_suffix": suffix.op10_suffix}
SQL = {"op3_mix": mixing.SQL, "op4_warc": warc.SQL, "op5_quality": quality.SQL, "op8_chat": chat.SQL}
