"""Schemas of timed-text tables and the limits that audits and repairs go by."""

from __future__ import annotations

#: word table: one timed word a row.
WORDS = "episode_id long, word_pos int, word string, start double, end double"
#: cue table: the central fact table.
CUES = "episode_id long, cue_pos int, start double, end double, text string"
#: cached transcription documents.
WORD_CACHE = "asr_engine string, language string, segments array<struct<index:int,start:double,end:double,text:string>>, words array<struct<word:string,start:double,end:double>>"
#: recogniser output: results of alternatives of words with offsets such as "1.5s".
RECOGNISED_WORDS = "array<struct<word:string,startOffset:string,endOffset:string>>"
RECOGNISED = f"results array<struct<languageCode:string,alternatives:array<struct<transcript:string,words:{RECOGNISED_WORDS}>>>>"

# Fixed values of the audit, in characters, characters a second and seconds.
LINE_LIMIT = {"cjk": 15, "ko": 16, "latin": 42}
CPS_LIMIT = {"cjk": 6.0, "ko": 6.5, "latin": 20.0}
COMFORTABLE_CPS = {"cjk": 5.5, "ko": 6.0, "latin": 16.0}
MIN_DURATION, MAX_DURATION, TAIL, TAIL_CEILING, MICRO_GAP = 1.0, 6.0, 0.4, 1.10, 0.2
LEAD_IN, SILENCE = 0.180, 10.0
LOCK_RATE, END_OVERRUN = 80.0, 0.5
WINDOW, WINDOW_OVERLAP = 1080.0, 5.0
CHUNK_SLACK, CLAUSE_SLACK = 2.0, 0.3
BRACKETS = ("()", "[]", "{}", "（）", "「」", "『』", "《》", "【】")
