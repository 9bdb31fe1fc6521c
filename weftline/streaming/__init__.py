"""The same dataflow documents over unbounded inputs."""
