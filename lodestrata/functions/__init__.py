"""functions of the point-cloud and building-document engine."""
