"""Jobs that follow a stream of new reviews."""
