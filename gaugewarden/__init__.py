"""Quality control of daily measurements from station networks, on Spark."""
