"""Evidence selection and corpus preparation as Spark DataFrame jobs."""
