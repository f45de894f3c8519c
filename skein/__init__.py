"""Detection over web traffic and curation of labelled corpora, as Spark DataFrame operators."""
