"""framesieve: shoot-culling analytics and corpus preparation as Spark DataFrame jobs."""
