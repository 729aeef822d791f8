"""The tables' schemas as DDL."""

SEQUENCES = "seq_id bigint, header string, seq string, seq_len bigint, multiline boolean, quality string, file_offset bigint, source_file string"
REFS = "ref_id int, name string, length int"
TAG = "struct<type:string,i:bigint,f:float,s:string,ia:array<bigint>,fa:array<float>>"
ALIGNMENTS = f"qname string, flag int, ref_id int, rname string, pos int, end_pos int, mapq smallint, cigar string, next_ref_id int, rname_next string, next_pos int, tlen int, seq string, qual string, bin int, voffset bigint, voffset_end bigint, tags map<string,{TAG}>"
BAI_BINS = "ref_id int, bin bigint, chunk_beg bigint, chunk_end bigint"
BAI_LINEAR = "ref_id int, win bigint, voffset bigint"
INDEX_PARTS = "kind string, ref_id int, at bigint, low bigint, high bigint"
GFF = "seqid string, source string, type string, start bigint, end bigint, score string, strand string, phase string, attributes string"
