"""lexiscope: Spark-native text tokenization and retrieval evaluation.

Every public function takes and returns DataFrames. Sub-packages:

* ``sources``   readers and writers (JSONL, TSV, text, Parquet, CSV)
* ``functions`` column expressions (text cleaning, counting, tokens, vectors)
* ``operators`` DataFrame operators (preparation, BPE, statistics, retrieval,
  metrics, vectorizers, n-gram language model)
* ``plans``     end-to-end jobs and the registered queries
* ``streaming`` incremental embedding of newly arriving files
"""

__version__ = "0.1.0"
