"""Schemas of the records that stages exchange."""

SENTENCES = "source_file string, sent_pos int, sentence string"
TOKENS = "array<struct<i:int,idx:int,text:string,lemma:string,pos:string,dep:string,head:int>>"
ENTITIES = "array<struct<text:string,start:int,end:int,label:string>>"
ANNOTATED = f"{SENTENCES}, tokens {TOKENS}, ents {ENTITIES}"
TRIPLE = "head string, relation string, tail string, confidence double, source_file string, source_sentence string"
MERGED = f"{TRIPLE}, extractor string"
ENVELOPE = f"total bigint, triples array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in MERGED.split(','))}>>"
ERRORS = "sentence string, error string, source_file string"
RELATIONSHIP = "struct<head:string,relation:string,tail:string,confidence:double,source_file:string,source_sentence:string,traversal_direction:string>"
JUDGEMENT_LISTS = ("unsupported", "direction_errors")
