"""quillrank: preference ranking and corpus preparation as Spark plans."""
