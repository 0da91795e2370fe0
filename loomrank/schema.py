"""Schemas of the tables that an index and a search are made of."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


INT, LONG, DOUBLE, FLOAT, STRING = T.IntegerType(), T.LongType(), T.DoubleType(), T.FloatType(), T.StringType()

#: Document ids per block of a segment: rows stay bounded however often a term occurs.
BLOCK_BITS = 16

DOCS = _struct(doc_id=INT, ext_id=STRING, doc_len=INT)
POSTINGS = _struct(term=STRING, doc_id=INT, tf=INT)
#: One row per segment (term, impact): its number of postings.
DIRECTORY = _struct(term=STRING, impact=INT, count=LONG)
#: A segment's ascending document ids, cut into ranges of ids so that no row grows with the collection.
BLOCKS = _struct(term=STRING, impact=INT, block=INT, docs=T.ArrayType(INT))
STATS = _struct(num_docs=LONG, avg_len=DOUBLE, max_score=FLOAT, quant_bits=INT, num_postings=LONG, num_levels=LONG, max_level=INT, max_doc_id=INT)
QUERY_TERMS = _struct(qid=LONG, pos=INT, token=STRING, weight=INT)
RESULTS = _struct(qid=LONG, rank=INT, doc_id=INT, ext_id=STRING, score=LONG)

TOKEN = _struct(token=STRING, freq=LONG)
#: A search request as it comes over the wire: exactly one of the two modes is set.
REQUEST = _struct(query=_struct(id=LONG, tokens=T.ArrayType(TOKEN)), k=INT, query_mode=_struct(Fraction=DOUBLE, Fixed=LONG))

CIFF_HEADER = _struct(version=INT, num_postings_lists=INT, num_docs=INT, total_postings_lists=INT, total_docs=INT, total_terms_in_collection=LONG, average_doclength=DOUBLE, description=STRING)
CIFF_POSTINGS = _struct(posn=LONG, term=STRING, df=LONG, cf=LONG, postings=T.ArrayType(_struct(docid=INT, tf=INT)))
CIFF_DOCS = _struct(posn=LONG, docid=INT, collection_docid=STRING, doclength=INT)
