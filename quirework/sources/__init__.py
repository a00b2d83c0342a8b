"""What yields blocks, and classifiers of raw inputs."""
