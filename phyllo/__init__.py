"""phyllo: point-cloud, segmentation and corpus analytics as Spark DataFrame operators."""
