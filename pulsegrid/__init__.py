"""pulsegrid: activity analytics for AI-assisted development, as Spark DataFrame jobs."""
