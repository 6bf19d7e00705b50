"""Document-structure analytics on Spark: operators over corpora of texts, declared as DataFrame plans."""
