"""clickloom: ad-click (CTR) data work expressed as Spark DataFrame jobs."""
