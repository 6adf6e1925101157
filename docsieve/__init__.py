"""docsieve: relevance classification of text records as Spark DataFrame jobs."""
