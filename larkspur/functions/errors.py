"""Classification of error messages, error codes and HTTP statuses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Object store error codes by class.
THROTTLING_CODES = (
    "SlowDown", "RequestLimitExceeded", "ProvisionedThroughputExceededException", "Throttling",
    "ThrottlingException", "RequestThrottled", "BandwidthLimitExceeded",
)
TRANSIENT_CODES = (
    "InternalError", "InternalFailure", "ServiceUnavailable", "ServiceException",
    "RequestTimeout", "RequestExpired",
)
PERMANENT_CODES = (
    "InvalidAccessKeyId", "SignatureDoesNotMatch", "AccessDenied", "AllAccessDisabled",
    "AccountProblem", "InvalidSecurity", "NoSuchBucket", "NoSuchKey", "NoSuchUpload",
    "NoSuchVersion", "404", "InvalidBucketName", "InvalidObjectName", "InvalidArgument",
    "MalformedPolicy", "MalformedXML", "InvalidRequest", "InvalidPart", "InvalidPartOrder",
    "UnauthorizedAccess",
)
# Failures of the connection, which carry no code of the store.
CONNECTION_ERRORS = (
    "EndpointConnectionError", "ConnectionClosedError", "ReadTimeoutError", "ConnectTimeoutError", "ConnectionError",
    "BotoCoreError", "HTTPClientError",
)
# HTTP statuses worth another attempt.
RETRIABLE_STATUSES = ("500", "502", "503", "504")


def error_class(message: Column) -> Column:
    """``circuit_breaker``, ``upstream`` or ``other``; the first match wins."""
    lowered = F.lower(message)
    return (
        F.when(F.contains(lowered, F.lit("circuit breaker")), "circuit_breaker")
        .when(F.contains(lowered, F.lit("upstream")), "upstream")
        .otherwise("other")
    )


def is_retriable(code: Column, http_status: Column) -> Column:
    """Whether a failed request may be sent again: failures of the connection may, unknown errors may not."""
    return (
        F.when(code.isin(*CONNECTION_ERRORS), F.lit(True))
        .when(code.isin(*PERMANENT_CODES), F.lit(False))
        .when(code.isin(*THROTTLING_CODES), F.lit(True))
        .when(code.isin(*TRANSIENT_CODES), F.lit(True))
        .otherwise(F.coalesce(http_status.cast("string").isin(*RETRIABLE_STATUSES), F.lit(False)))
    )
