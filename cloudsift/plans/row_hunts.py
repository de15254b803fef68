"""Row hunts over the audit trail as data: predicate, JSON columns, newest first."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudsift.operators import shape as S

KEEP = ("event_time", "event_name", "event_source", "user_identity_arn", "source_ip_address", "aws_region", "error_code", "event_id")


@dataclass(frozen=True)
class RowHunt:
    """One hunt: id, severity, rows of its report, and what a row must be.

    A source stands for its name under .amazonaws.com. `request`, `response` and `additional` name columns by the paths of
    the request parameters, the response and the additional data that fill them. The further condition is Spark SQL.
    """

    id: str
    severity: str
    limit: int
    sources: tuple[str, ...] = ()
    actions: tuple[str, ...] = ()
    request: Mapping[str, str] = field(default_factory=dict)
    additional: Mapping[str, str] = field(default_factory=dict)
    response: Mapping[str, str] = field(default_factory=dict)
    condition: str = ""

    @property
    def title(self) -> str:
        """What it looks for, in short."""
        first = ", ".join(self.actions[:2]) or self.condition
        more = f" and {len(self.actions) - 2} more" if len(self.actions) > 2 else ""
        return f"{first}{more}" + (f" of {', '.join(self.sources)}" if self.sources else "")

    @property
    def paths(self) -> dict[str, tuple[str, str]]:
        """Column and JSON path of each named column."""
        path = lambda p: f"${p}" if p.startswith("[") else f"$.{p}"
        return {n: ("request_parameters", path(p)) for n, p in self.request.items()} | {n: ("response_elements", path(p)) for n, p in self.response.items()} | {n: ("additional_event_data", path(p)) for n, p in self.additional.items()}

    def where(self) -> Column:
        """Its whole predicate."""
        out = F.lit(True)
        if self.sources:
            out = out & F.col("event_source").isin(*(f"{s}.amazonaws.com" for s in self.sources))
        if self.actions:
            out = out & F.col("event_name").isin(*self.actions)
        return out & F.expr(self.condition) if self.condition else out

    def run(self, events: DataFrame, limit: int | None = None) -> DataFrame:
        """The newest matching rows; ties go by event id."""
        order = [F.col("event_time").desc_nulls_last(), F.col("event_id").asc_nulls_last()]
        return S.event_hunt(events, self.where(), self.paths, KEEP, order, limit if limit is not None else self.limit)


# Services, actions, parameters and limits of the hunts.
ALL = [
    RowHunt("H001", "P1", 100, actions=("CreateTrail", "UpdateTrail", "DeleteTrail", "StartLogging", "StopLogging", "PutEventSelectors", "PutInsightSelectors"), request={"trail_name": "name", "trail_arn": "trailARN", "retention_days": "retentionInDays"}),
    RowHunt("H002", "P1", 100, sources=("guardduty",), actions=("UpdateDetector", "DeleteDetector", "DeletePublishingDestination", "CreateIPSet", "DeleteIPSet", "CreateThreatIntelSet", "DeleteThreatIntelSet", "CreateFilter", "UpdateFilter", "ArchiveFindings"), request={"detector_id": "detectorId", "enable_flag": "enable", "destination_id": "destinationId", "filter_name": "name", "filter_action": "action"}),
    RowHunt("H003", "P1", 100, sources=("securityhub",), actions=("DisableSecurityHub", "BatchDisableStandards", "DisableImportFindingsForProduct", "BatchUpdateFindings", "UpdateStandardsControl", "DeleteInsight")),
    RowHunt("H004", "P1", 100, sources=("config",), actions=("StopConfigurationRecorder", "DeleteConfigurationRecorder", "DeleteDeliveryChannel", "DeleteConfigRule", "PutConfigRule"), request={"config_rule_name": "configRuleName", "recorder_name": "configurationRecorderName"}),
    RowHunt("H005", "P1", 100, sources=("organizations",), actions=("CreatePolicy", "UpdatePolicy", "DeletePolicy", "AttachPolicy", "DetachPolicy", "EnablePolicyType", "DisablePolicyType"), request={"policy_id": "policyId", "target_id": "targetId", "policy_type": "type", "policy_name": "name", "policy_content": "content"}, condition="coalesce(get_json_object(request_parameters, '$.type'), 'SERVICE_CONTROL_POLICY') = 'SERVICE_CONTROL_POLICY' or contains(request_parameters, 'SERVICE_CONTROL_POLICY')"),
    RowHunt("H006", "P2", 100, sources=("macie2",), actions=("DisableMacie", "CreateFindingsFilter", "UpdateFindingsFilter", "DeleteFindingsFilter", "DisableOrganizationAdminAccount", "UpdateMacieSession", "CreateClassificationJob", "UpdateClassificationJob"), request={"job_or_filter_id": "id", "resource_name": "name"}),
    RowHunt("H007", "P2", 100, sources=("monitoring",), actions=("DeleteAlarms", "DisableAlarmActions", "PutMetricAlarm", "DeleteDashboard"), request={"alarm_name": "alarmName", "alarm_names": "alarmNames", "threshold": "threshold"}),
    RowHunt("H008", "P1", 100, sources=("logs",), actions=("PutSubscriptionFilter", "DeleteSubscriptionFilter", "DeleteLogGroup", "DeleteLogStream", "PutRetentionPolicy", "DeleteRetentionPolicy", "DeleteDelivery", "DisassociateKmsKey"), request={"log_group_name": "logGroupName", "filter_name": "filterName", "destination_arn": "destinationArn", "retention_days": "retentionInDays"}),
    RowHunt("H009", "P2", 100, sources=("wafv2", "waf", "waf-regional"), actions=("CreateWebACL", "UpdateWebACL", "DeleteWebACL", "AssociateWebACL", "DisassociateWebACL"), request={"waf_name": "name", "waf_id": "id", "scope": "scope"}),
    RowHunt("H010", "P3", 200, sources=("guardduty",), actions=("ListFindings", "GetFindings", "GetDetector", "ListDetectors", "ListIPSets", "GetIPSet", "ListThreatIntelSets", "GetThreatIntelSet", "GetMasterAccount", "ListMembers"), request={"detector_id": "detectorId"}),
    RowHunt("H011", "P3", 200, actions=("DescribeTrails", "GetTrailStatus", "GetEventSelectors", "GetInsightSelectors", "ListTrails", "ListDetectors", "GetDetector", "GetFindingsStatistics", "ListFindings", "ListIPSets", "ListThreatIntelSets", "DescribeConfigurationRecorders", "DescribeConfigurationRecorderStatus", "DescribeDeliveryChannels", "DescribeConfigRules", "ListAnalyzers", "DescribeHub", "GetEnabledStandards", "DescribeFlowLogs", "DescribeAlarms", "DescribeLogGroups")),
    RowHunt("H012", "P3", 100, sources=("budgets", "ce"), actions=("CreateBudget", "DeleteBudget", "UpdateBudget", "CreateNotification", "DeleteNotification", "CreateBudgetAction", "DeleteBudgetAction", "CreateAnomalyMonitor", "DeleteAnomalyMonitor", "UpdateAnomalyMonitor", "CreateAnomalySubscription", "DeleteAnomalySubscription"), request={"budget_name": "budgetName", "monitor_arn": "monitorArn"}),
    RowHunt("H015", "P1", 100, condition="user_identity_type = 'Root'"),
    RowHunt("H016", "P2", 100, sources=("signin",), actions=("ConsoleLogin",), additional={"mfa_used": "MFAUsed", "login_to": "LoginTo"}, condition="get_json_object(additional_event_data, '$.MFAUsed') = 'No'"),
    RowHunt("H017", "P3", 200, sources=("signin",), actions=("ConsoleLogin", "CreateOAuth2Token", "AuthorizeOAuth2Access")),
    RowHunt("H018", "P2", 100, actions=("CreateVirtualMFADevice", "DeactivateMFADevice", "DeleteVirtualMFADevice", "EnableMFADevice", "ChangePassword", "UpdateLoginProfile", "DeleteLoginProfile"), request={"target_user": "userName"}),
    RowHunt("H019", "P1", 100, actions=("PutUserPolicy", "AttachUserPolicy", "PutRolePolicy", "AttachRolePolicy", "CreatePolicyVersion", "SetDefaultPolicyVersion", "AttachGroupPolicy", "PutGroupPolicy", "CreateGroup"), request={"target_user": "userName", "target_role": "roleName", "policy_arn": "policyArn"}),
    RowHunt("H020", "P1", 100, actions=("UpdateAssumeRolePolicy",), request={"role_name": "roleName", "policy_document": "policyDocument"}),
    RowHunt("H021", "P2", 100, sources=("iam",), actions=("PutUserPermissionsBoundary", "DeleteUserPermissionsBoundary", "PutRolePermissionsBoundary", "DeleteRolePermissionsBoundary"), request={"target_user": "userName", "target_role": "roleName", "permissions_boundary": "permissionsBoundary"}),
    RowHunt("H022", "P1", 100, actions=("AddUserToGroup",), request={"target_user": "userName", "group_name": "groupName"}, condition="contains(lower(get_json_object(request_parameters, '$.groupName')), 'admin')"),
    RowHunt("H023", "P2", 200, actions=("AddUserToGroup", "RemoveUserFromGroup", "CreateGroup", "DeleteGroup"), request={"target_user": "userName", "group_name": "groupName"}),
    RowHunt("H024", "P2", 100, actions=("CreateUser", "CreateAccessKey", "CreateLoginProfile"), request={"new_user": "userName"}),
    RowHunt("H025", "P2", 100, request={"lambda_function": "functionName", "ec2_instance": "instanceId", "notebook_name": "notebookInstanceName", "glue_endpoint": "endpointName"}, condition=r"""(event_name in ('RunInstances', 'CreateFunction20150331', 'CreateFunction', 'UpdateFunctionConfiguration20150331v2', 'UpdateFunctionConfiguration', 'CreateNotebookInstance', 'UpdateNotebookInstance', 'CreateTrainingJob', 'CreateProcessingJob', 'CreateDevEndpoint', 'UpdateDevEndpoint', 'RegisterTaskDefinition', 'StartAutomationExecution', 'CreateStateMachine', 'UpdateStateMachine') or event_source in ('datapipeline.amazonaws.com', 'codestar.amazonaws.com') and event_name in ('CreatePipeline', 'PutPipelineDefinition', 'ActivatePipeline', 'CreateProject', 'CreateProjectFromTemplate')) and (contains(request_parameters, 'roleArn') or contains(request_parameters, 'iamInstanceProfile') or contains(request_parameters, '"role"'))"""),
    RowHunt("H026", "P2", 100, condition="user_identity_account_id <> recipient_account_id"),
    RowHunt("H027", "P2", 100, sources=("sts",), actions=("GetFederationToken", "GetSessionToken"), request={"federation_name": "name", "duration_seconds": "durationSeconds"}),
    RowHunt("H028", "P2", 100, sources=("sts",), actions=("AssumeRoleWithWebIdentity", "AssumeRoleWithSAML"), request={"role_arn": "roleArn", "session_name": "roleSessionName", "saml_principal_arn": "principalArn"}),
    RowHunt("H029", "P2", 200, sources=("sso", "sso-directory", "identitystore", "sso-oauth")),
    RowHunt("H030", "P1", 100, sources=("iam",), actions=("CreateSAMLProvider", "UpdateSAMLProvider", "DeleteSAMLProvider", "CreateOpenIDConnectProvider", "DeleteOpenIDConnectProvider", "UpdateOpenIDConnectProviderThumbprint", "AddClientIDToOpenIDConnectProvider", "RemoveClientIDFromOpenIDConnectProvider"), request={"saml_provider_arn": "sAMLProviderArn", "oidc_provider_arn": "openIDConnectProviderArn", "oidc_url": "url", "oidc_client_id": "clientID"}),
    RowHunt("H031", "P3", 200, sources=("access-analyzer",), request={"analyzer_arn": "analyzerArn"}),
    RowHunt("H032", "P3", 200, actions=("GenerateCredentialReport", "GetCredentialReport", "ListUsers", "ListRoles", "ListPolicies", "GetAccountAuthorizationDetails", "ListAttachedUserPolicies", "ListAttachedRolePolicies", "ListUserPolicies", "ListRolePolicies", "ListGroupsForUser", "GetPolicyVersion", "ListAccessKeys", "ListInstanceProfiles", "ListVirtualMFADevices")),
    RowHunt("H034", "P2", 100, sources=("organizations",), actions=("CreateAccount", "InviteAccountToOrganization", "CreateOrganizationalUnit", "MoveAccount", "AttachPolicy", "DetachPolicy", "LeaveOrganization", "RemoveAccountFromOrganization", "AcceptHandshake", "CancelHandshake", "DeclineHandshake"), request={"account_name": "accountName", "target_account_id": "accountId", "account_email": "email", "service_principal": "servicePrincipal", "handshake_id": "handshakeId"}),
    RowHunt("H035", "P3", 100, sources=("cognito-identity",), actions=("CreateIdentityPool", "UpdateIdentityPool", "SetIdentityPoolRoles"), request={"identity_pool_id": "identityPoolId", "identity_pool_name": "identityPoolName", "allow_unauthenticated": "allowUnauthenticatedIdentities"}, condition=r"""contains(request_parameters, '"allowUnauthenticatedIdentities":true') or contains(request_parameters, 'allowUnauthenticatedIdentities=true')"""),
    RowHunt("H036", "P2", 100, sources=("glue",), actions=("CreateDevEndpoint", "UpdateDevEndpoint", "DeleteDevEndpoint", "GetDevEndpoint", "GetDevEndpoints", "GetConnections", "GetConnection", "CreateConnection", "DeleteConnection"), request={"endpoint_name": "endpointName", "role_arn": "roleArn", "connection_name": "connectionName", "public_key": "publicKey"}),
    RowHunt("H037", "P2", 100, sources=("sagemaker",), actions=("CreateNotebookInstance", "UpdateNotebookInstance", "DeleteNotebookInstance", "StartNotebookInstance", "StopNotebookInstance", "CreatePresignedNotebookInstanceUrl", "CreateTrainingJob", "CreateProcessingJob", "CreateTransformJob", "CreateHyperParameterTuningJob"), request={"notebook_name": "notebookInstanceName", "role_arn": "roleArn", "instance_type": "instanceType"}),
    RowHunt("H038", "P2", 100, sources=("iam",), actions=("DeleteUser", "DeleteRole", "DeleteAccessKey", "DeleteLoginProfile", "DeletePolicy", "DeleteRolePolicy", "DeleteUserPolicy", "DeleteGroup", "DeleteGroupPolicy", "DeleteVirtualMFADevice", "DeactivateMFADevice", "DeleteInstanceProfile")),
    RowHunt("H039", "P1", 100, actions=("AssumeRoot",), request={"target_principal": "targetPrincipal", "task_policy_arn": "taskPolicyArn.arn"}),
    RowHunt("H041", "P1", 100, sources=("backup",), actions=("DeleteBackupVault", "DeleteBackupPlan", "DeleteRecoveryPoint", "DeleteBackupSelection", "DisassociateRecoveryPoint", "PutBackupVaultAccessPolicy", "DeleteBackupVaultLockConfiguration"), request={"vault_name": "backupVaultName", "plan_id": "backupPlanId", "recovery_point_arn": "recoveryPointArn"}),
    RowHunt("H042", "P2", 100, sources=("kms",), actions=("CreateKey", "ReplicateKey", "Encrypt", "ReEncrypt", "Decrypt", "DisableKey", "ScheduleKeyDeletion", "CancelKeyDeletion", "CreateGrant", "RevokeGrant", "RetireGrant", "PutKeyPolicy"), request={"key_id": "keyId", "destination_key_id": "destinationKeyId", "grantee_principal": "granteePrincipal"}),
    RowHunt("H043", "P1", 100, request={"bucket_name": "bucketName", "block_config": "PublicAccessBlockConfiguration"}, condition=r"""event_name = 'DeletePublicAccessBlock' or event_name = 'PutPublicAccessBlock' and request_parameters rlike '"(blockPublicAcls|blockPublicPolicy|ignorePublicAcls|restrictPublicBuckets)":false'"""),
    RowHunt("H044", "P2", 100, sources=("s3",), actions=("PutBucketPolicy", "DeleteBucketPolicy", "PutBucketAcl", "PutObjectAcl", "PutBucketCors", "PutBucketWebsite", "DeleteBucketWebsite"), request={"bucket_name": "bucketName", "object_key": "key", "requested_acl": "['x-amz-acl']"}),
    RowHunt("H047", "P2", 100, sources=("secretsmanager",), actions=("DeleteSecret", "PutResourcePolicy", "DeleteResourcePolicy", "RemoveRegionsFromReplication", "ReplicateSecretToRegions", "CancelRotateSecret"), request={"secret_id": "secretId", "recovery_window_days": "recoveryWindowInDays", "resource_policy": "resourcePolicy"}),
    RowHunt("H049", "P1", 100, actions=("ModifyDBSnapshotAttribute", "ModifyDBClusterSnapshotAttribute"), request={"snapshot_id": "dBSnapshotIdentifier", "cluster_snapshot_id": "dBClusterSnapshotIdentifier", "attribute_name": "attributeName"}, condition="contains(request_parameters, 'restore') or contains(request_parameters, 'valuesToAdd')"),
    RowHunt("H050", "P2", 100, actions=("DeleteDBInstance", "DeleteDBCluster"), request={"db_instance": "dBInstanceIdentifier", "db_cluster": "dBClusterIdentifier"}, condition="get_json_object(request_parameters, '$.skipFinalSnapshot') = 'true'"),
    RowHunt("H051", "P2", 100, sources=("rds",), actions=("CreateDBInstance", "ModifyDBInstance", "RestoreDBInstanceFromDBSnapshot", "RestoreDBInstanceFromS3", "RestoreDBInstanceToPointInTime"), request={"db_instance": "dBInstanceIdentifier", "publicly_accessible": "publiclyAccessible"}, condition=r"""contains(request_parameters, '"publiclyAccessible":true') or contains(request_parameters, 'publiclyAccessible=true')"""),
    RowHunt("H052", "P2", 100, sources=("dynamodb",), actions=("ExportTableToPointInTime", "DeleteTable", "CreateGlobalTable", "UpdateContinuousBackups"), request={"table_name": "tableName", "export_s3_bucket": "s3Bucket", "s3_bucket_owner": "s3BucketOwner", "export_format": "exportFormat"}),
    RowHunt("H053", "P2", 100, sources=("ebs",), actions=("ListSnapshotBlocks", "GetSnapshotBlock", "ListChangedBlocks", "PutSnapshotBlock", "StartSnapshot", "CompleteSnapshot"), request={"snapshot_id": "snapshotId", "block_index": "blockIndex", "volume_size_gb": "volumeSize", "description": "description"}),
    RowHunt("H054", "P2", 100, sources=("firehose", "kinesis"), actions=("CreateDeliveryStream", "UpdateDestination", "DeleteDeliveryStream", "CreateStream", "StopStreamEncryption", "MergeShards", "SplitShard"), request={"stream_name": "deliveryStreamName", "kinesis_stream": "streamName"}),
    RowHunt("H055", "P2", 100, sources=("s3",), actions=("PutBucketReplication", "DeleteBucketReplication"), request={"bucket_name": "bucketName"}),
    RowHunt("H056", "P1", 100, sources=("s3",), actions=("PutBucketVersioning", "PutBucketLogging"), request={"bucket_name": "bucketName"}, condition=r"""contains(request_parameters, 'Suspended') or contains(request_parameters, '"BucketLoggingStatus":{}') or contains(request_parameters, '"LoggingEnabled":{}')"""),
    RowHunt("H057", "P3", 100, sources=("ses",), actions=("CreateReceiptRule", "UpdateReceiptRule", "DeleteReceiptRule", "SetIdentityFeedbackForwardingEnabled", "VerifyEmailIdentity", "VerifyDomainIdentity", "DeleteIdentity", "PutEmailIdentityMailFromAttributes", "CreateEmailIdentity", "DeleteEmailIdentity"), request={"ses_identity": "identity", "email_address": "emailAddress", "domain": "domain", "rule_set_name": "ruleSetName", "rule_name": "rule.name", "forwarding_enabled": "forwardingEnabled"}),
    RowHunt("H058", "P2", 200, actions=("SetSMSAttributes", "OptInPhoneNumber", "CheckIfPhoneNumberIsOptedOut", "UpdateAccountSendingEnabled", "PutAccountSendingAttributes", "PutAccountDetails", "UpdateConfigurationSetSendingEnabled", "SendRawEmail", "SendTemplatedEmail", "SendBulkTemplatedEmail", "SendBulkEmail"), request={"phone_number": "phoneNumber"}),
    RowHunt("H059", "P3", 100, request={"permission_label": "label", "granted_account_id": "awsAccountId", "subscription_endpoint": "endpoint"}, condition="event_source = 'sqs.amazonaws.com' and event_name in ('SetQueueAttributes', 'AddPermission', 'RemovePermission') or event_source = 'sns.amazonaws.com' and event_name in ('AddPermission', 'RemovePermission', 'SetTopicAttributes', 'Subscribe')"),
    RowHunt("H060", "P1", 100, actions=("ModifySnapshotAttribute", "ModifyImageAttribute"), request={"snapshot_id": "snapshotId", "image_id": "imageId"}, condition=r"""contains(lower(request_parameters), '"all"') or contains(lower(request_parameters), 'group=all')"""),
    RowHunt("H062", "P1", 100, sources=("s3",), request={"bucket_name": "bucketName", "object_key": "key"}, additional={"sse_applied": "SSEApplied"}, condition=r"""event_name in ('CopyObject', 'PutObject') and (get_json_object(additional_event_data, '$.SSEApplied') = 'SSE_C' or get_json_object(request_parameters, "$['x-amz-server-side-encryption-customer-algorithm']") is not null) or event_name = 'PutBucketEncryption'"""),
    RowHunt("H063", "P1", 100, sources=("s3",), actions=("PutObject",), request={"bucket_name": "bucketName", "object_key": "key"}, condition="upper(get_json_object(request_parameters, '$.key')) rlike 'RANSOM|DECRYPT|RECOVER|RESTORE[_-]?FILES|README|HOW[_-]?TO|YOUR[_-]?FILES|UNLOCK'"),
    RowHunt("H064", "P2", 100, sources=("s3",), actions=("PutBucketLifecycle", "PutBucketLifecycleConfiguration", "DeleteBucketLifecycle"), request={"bucket_name": "bucketName"}),
    RowHunt("H065", "P3", 100, condition="event_source = 'rds-data.amazonaws.com' and event_name in ('ExecuteStatement', 'BatchExecuteStatement') or event_source = 'rds.amazonaws.com' and (event_name in ('ModifyDBInstance', 'ModifyDBCluster') and get_json_object(request_parameters, '$.masterUserPassword') is not null or event_name in ('RestoreDBInstanceFromDBSnapshot', 'RestoreDBClusterFromSnapshot', 'DownloadDBLogFilePortion'))"),
    RowHunt("H067", "P1", 100, request={"kms_key_id": "kmsKeyId"}, condition="event_name in ('CopySnapshot', 'CopyImage', 'CreateVolume', 'CopyDBSnapshot', 'CopyDBClusterSnapshot') and get_json_object(request_parameters, '$.kmsKeyId') is not null or event_name = 'DisableEbsEncryptionByDefault'"),
    RowHunt("H069", "P2", 200, sources=("s3",), request={"destination_bucket": "bucketName", "destination_key": "key"}, condition="event_name = 'CopyObject' or event_name = 'PutObject' and contains(request_parameters, 'x-amz-copy-source')"),
    RowHunt("H072", "P2", 200, sources=("ssm",), actions=("StartSession", "TerminateSession", "ResumeSession", "SendCommand", "StartAutomationExecution"), request={"target_instance": "target", "document_name": "documentName"}),
    RowHunt("H073", "P2", 200, sources=("ec2-instance-connect",), actions=("SendSSHPublicKey", "SendSerialConsoleSSHPublicKey"), request={"instance_id": "instanceId", "os_user": "osUser", "serial_port": "serialPort"}),
    RowHunt("H074", "P2", 100, sources=("ec2",), actions=("ModifyInstanceAttribute",), request={"instance_id": "instanceId"}, condition="contains(request_parameters, 'userData')"),
    RowHunt("H075", "P2", 100, actions=("CreateFunction20150331", "CreateFunction", "UpdateFunctionCode20150331v2", "UpdateFunctionCode", "UpdateFunctionConfiguration20150331v2", "UpdateFunctionConfiguration", "AddPermission20150331v2", "AddPermission", "CreateEventSourceMapping", "CreateFunctionUrlConfig", "UpdateFunctionUrlConfig"), request={"function_name": "functionName", "runtime": "runtime", "function_url_auth_type": "authType"}),
    RowHunt("H076", "P2", 100, sources=("lambda",), actions=("PublishLayerVersion", "DeleteLayerVersion", "AddLayerVersionPermission", "RemoveLayerVersionPermission"), request={"layer_name": "layerName", "version_number": "versionNumber", "principal": "principal"}),
    RowHunt("H077", "P3", 100, sources=("ecs",), actions=("RegisterTaskDefinition", "DeregisterTaskDefinition", "UpdateService", "CreateService", "DeleteService", "RunTask", "StartTask", "StopTask"), request={"cluster": "cluster", "service_name": "service"}),
    RowHunt("H078", "P2", 100, sources=("ec2",), actions=("AssociateIamInstanceProfile", "DisassociateIamInstanceProfile", "ReplaceIamInstanceProfileAssociation"), request={"instance_id": "instanceId", "iam_profile": "iamInstanceProfile", "association_id": "associationId"}),
    RowHunt("H079", "P3", 100, actions=("RunInstances",), request={"instance_type": "instanceType", "min_count": "minCount", "max_count": "maxCount", "key_name": "keyName", "ami_id": "imageId"}),
    RowHunt("H080", "P3", 100, request={"spot_target_capacity": "spotFleetRequestConfig.targetCapacity", "instance_count": "instanceCount", "asg_name": "autoScalingGroupName", "asg_max_size": "maxSize"}, condition="event_source = 'ec2.amazonaws.com' and event_name in ('RequestSpotFleet', 'CancelSpotFleetRequests', 'RequestSpotInstances', 'PurchaseReservedInstancesOffering', 'ModifyReservedInstances') or event_source = 'autoscaling.amazonaws.com' and event_name in ('CreateAutoScalingGroup', 'UpdateAutoScalingGroup', 'PutScalingPolicy', 'ExecutePolicy')"),
    RowHunt("H081", "P3", 100, sources=("eks",), actions=("CreateCluster", "DeleteCluster", "UpdateClusterConfig", "CreateNodegroup", "DeleteNodegroup", "CreateFargateProfile", "DeleteFargateProfile", "CreateAddon", "DeleteAddon", "UpdateAddon", "AssociateAccessPolicy", "DisassociateAccessPolicy", "CreateAccessEntry", "DeleteAccessEntry")),
    RowHunt("H082", "P2", 100, sources=("ecr",), actions=("CreateRepository", "DeleteRepository", "PutLifecyclePolicy", "DeleteLifecyclePolicy", "SetRepositoryPolicy", "DeleteRepositoryPolicy", "InitiateLayerUpload", "CompleteLayerUpload", "PutImage", "BatchDeleteImage"), request={"repository_name": "repositoryName", "image_tag": "imageTag"}),
    RowHunt("H083", "P3", 100, sources=("events", "scheduler"), actions=("PutRule", "DeleteRule", "DisableRule", "EnableRule", "PutTargets", "RemoveTargets", "CreateSchedule", "UpdateSchedule", "DeleteSchedule"), request={"rule_name": "name"}),
    RowHunt("H084", "P3", 100, sources=("lightsail",), actions=("GetInstanceAccessDetails", "CreateKeyPair", "ImportKeyPair", "DownloadDefaultKeyPair", "GetRelationalDatabaseMasterUserPassword", "OpenInstancePublicPorts", "CloseInstancePublicPorts", "CreateInstances", "DeleteInstance", "CreateInstanceSnapshot", "ExportSnapshot", "CreateInstanceFromSnapshot")),
    RowHunt("H085", "P2", 100, actions=("ModifyInstanceMetadataOptions",)),
    RowHunt("H088", "P3", 100, sources=("bedrock",), actions=("PutUseCaseForModelAccess", "PutFoundationModelEntitlement", "CreateFoundationModelAgreement", "PutModelAccessConfig", "CreateProvisionedModelThroughput"), request={"model_id": "modelId"}),
    RowHunt("H089", "P1", 100, sources=("bedrock",), actions=("DeleteModelInvocationLoggingConfiguration", "PutModelInvocationLoggingConfiguration", "GetModelInvocationLoggingConfiguration")),
    RowHunt("H092", "P1", 200, request={"resource_name": "name", "evaluator_id": "evaluatorId"}, condition="event_source = 'bedrock-agentcore.amazonaws.com' and event_name in ('CreateEvaluator', 'UpdateEvaluator', 'DeleteEvaluator', 'CreateOnlineEvaluationConfig', 'UpdateOnlineEvaluationConfig', 'DeleteOnlineEvaluationConfig') or event_source = 'xray.amazonaws.com' and event_name in ('UpdateTraceSegmentDestination', 'UpdateIndexingRule', 'UpdateSamplingRule', 'DeleteSamplingRule')"),
    RowHunt("H093", "P2", 200, sources=("bedrock-agentcore",), actions=("CreateCodeInterpreter", "DeleteCodeInterpreter", "CreateBrowser", "DeleteBrowser", "CreateBrowserProfile", "DeleteBrowserProfile")),
    RowHunt("H094", "P2", 200, sources=("bedrock-agentcore",), actions=("CreateMemory", "UpdateMemory", "DeleteMemory", "CreateRegistryRecord", "UpdateRegistryRecord", "UpdateRegistryRecordStatus", "DeleteRegistryRecord"), request={"memory_id": "memoryId", "resource_name": "name"}),
    RowHunt("H095", "P1", 200, sources=("bedrock-agentcore",), actions=("CreateGateway", "UpdateGateway", "DeleteGateway", "CreateGatewayTarget", "UpdateGatewayTarget", "DeleteGatewayTarget", "CreatePolicy", "UpdatePolicy", "DeletePolicy", "CreatePolicyEngine", "UpdatePolicyEngine", "PutResourcePolicy", "DeleteResourcePolicy"), request={"gateway_id": "gatewayIdentifier"}),
    RowHunt("H097", "P3", 100, actions=("AuthorizeSecurityGroupIngress", "AuthorizeSecurityGroupEgress", "RevokeSecurityGroupIngress", "RevokeSecurityGroupEgress", "CreateSecurityGroup", "DeleteSecurityGroup", "ModifySecurityGroupRules"), request={"security_group_id": "groupId"}),
    RowHunt("H098", "P2", 100, sources=("ec2",), actions=("DeleteFlowLogs", "CreateFlowLogs")),
    RowHunt("H099", "P2", 100, sources=("cloudfront",), actions=("CreateDistribution", "UpdateDistribution", "DeleteDistribution", "CreateCachePolicy", "UpdateCachePolicy", "CreateOriginAccessControl", "UpdateOriginAccessControl", "AssociateAlias"), request={"distribution_id": "id"}),
    RowHunt("H100", "P3", 100, sources=("ec2",), actions=("CreateNetworkAcl", "DeleteNetworkAcl", "CreateNetworkAclEntry", "DeleteNetworkAclEntry", "ReplaceNetworkAclEntry", "ReplaceNetworkAclAssociation"), request={"nacl_id": "networkAclId"}),
    RowHunt("H101", "P3", 100, sources=("ec2",), actions=("CreateRoute", "DeleteRoute", "ReplaceRoute", "CreateRouteTable", "DeleteRouteTable", "AssociateRouteTable", "DisassociateRouteTable", "ReplaceRouteTableAssociation"), request={"route_table_id": "routeTableId", "destination_cidr": "destinationCidrBlock"}),
    RowHunt("H102", "P3", 100, sources=("ec2",), actions=("CreateTransitGateway", "DeleteTransitGateway", "CreateTransitGatewayAttachment", "DeleteTransitGatewayAttachment", "AcceptTransitGatewayVpcAttachment", "CreateVpnConnection", "DeleteVpnConnection", "CreateVpnGateway", "DeleteVpnGateway", "CreateCustomerGateway", "DeleteCustomerGateway"), request={"tgw_id": "transitGatewayId", "vpn_id": "vpnConnectionId", "dx_connection_id": "connectionId"}),
    RowHunt("H103", "P4", 100, sources=("ec2",), actions=("AllocateAddress", "AssociateAddress", "DisassociateAddress", "ReleaseAddress"), request={"domain": "domain", "allocation_id": "allocationId", "instance_id": "instanceId"}, response={"public_ip": "publicIp"}),
    RowHunt("H104", "P3", 100, actions=("CreateKeyPair", "ImportKeyPair"), request={"key_name": "keyName"}, response={"key_fingerprint": "keyFingerprint"}),
    RowHunt("H105", "P3", 100, actions=("CreateVpc", "DeleteVpc", "CreateSubnet", "DeleteSubnet", "CreateInternetGateway", "AttachInternetGateway", "DetachInternetGateway", "CreateNatGateway", "DeleteNatGateway", "CreateVpcPeeringConnection", "AcceptVpcPeeringConnection", "ModifyVpcAttribute")),
    RowHunt("H106", "P3", 100, sources=("acm",), actions=("RequestCertificate", "DeleteCertificate", "ImportCertificate", "ExportCertificate"), request={"domain_name": "domainName", "san_names": "subjectAlternativeNames", "cert_arn": "certificateArn", "validation_method": "validationMethod"}),
    RowHunt("H107", "P3", 100, sources=("apigateway",), actions=("CreateApiKey", "UpdateApiKey", "DeleteApiKey", "CreateRestApi", "DeleteRestApi", "ImportRestApi", "CreateAuthorizer", "UpdateAuthorizer", "DeleteAuthorizer", "CreateDeployment", "UpdateAccount", "CreateUsagePlan", "DeleteUsagePlan")),
    RowHunt("H108", "P2", 100, sources=("workspaces",), actions=("CreateWorkspaces", "CreateWorkspacesPool", "CreateStandbyWorkspaces", "ModifyWorkspaceProperties", "RebuildWorkspaces"), request={"directory_id": "directoryId"}),
    RowHunt("H109", "P3", 100, sources=("support",), actions=("ResolveCase", "AddCommunicationToCase", "CreateCase", "DescribeCases"), request={"case_id": "caseId"}),
    RowHunt("H110", "P2", 100, sources=("cognito-idp",), actions=("UpdateUserPoolClient", "CreateUserPoolClient", "UpdateUserPool", "AdminCreateUser", "AdminSetUserPassword"), request={"user_pool_id": "userPoolId", "refresh_token_validity": "refreshTokenValidity"}),
    RowHunt("H111", "P1", 100, sources=("organizations",), actions=("RegisterDelegatedAdministrator", "DeregisterDelegatedAdministrator", "EnableAWSServiceAccess", "DisableAWSServiceAccess"), request={"delegated_account_id": "accountId", "service_principal": "servicePrincipal"}),
    RowHunt("H112", "P2", 200, sources=("identitystore",), actions=("CreateUser", "UpdateUser", "DeleteUser", "CreateGroup", "DeleteGroup", "CreateGroupMembership", "DeleteGroupMembership"), request={"identity_store_id": "identityStoreId", "user_name": "userName", "group_id": "groupId", "member_id": "memberId"}),
    RowHunt("H113", "P1", 200, sources=("sso",), actions=("CreatePermissionSet", "UpdatePermissionSet", "DeletePermissionSet", "AttachManagedPolicyToPermissionSet", "PutInlinePolicyToPermissionSet", "AttachCustomerManagedPolicyReferenceToPermissionSet", "CreateAccountAssignment", "DeleteAccountAssignment", "ProvisionPermissionSet"), request={"permission_set_name": "name", "permission_set_arn": "permissionSetArn", "managed_policy_arn": "managedPolicyArn", "target_account_id": "targetId", "principal_id": "principalId", "instance_arn": "instanceArn"}),
    RowHunt("H114", "P2", 200, actions=("ConsoleLogin",), additional={"federated_provider": "federatedProvider", "mfa_used": "MFAUsed"}, condition="get_json_object(additional_event_data, '$.federatedProvider') is not null"),
    RowHunt("H117", "P2", 200, actions=("AssumeRole", "AssumeRoleWithSAML", "AssumeRoleWithWebIdentity"), request={"target_role_arn": "roleArn", "session_name": "roleSessionName", "external_id": "externalId"}, condition="split_part(get_json_object(request_parameters, '$.roleArn'), ':', 5) <> user_identity_account_id"),
    RowHunt("H119", "P2", 200, actions=("AssumeRole",), request={"to_role": "roleArn", "session_name": "roleSessionName", "duration_seconds": "durationSeconds"}, condition="user_identity_type = 'AssumedRole' and session_issuer_arn is not null"),
    RowHunt("H120", "P3", 100, sources=("route53", "route53domains"), actions=("ChangeResourceRecordSets", "CreateHostedZone", "DeleteHostedZone", "RegisterDomain", "TransferDomain", "DisableDomainTransferLock", "UpdateDomainNameservers")),
    RowHunt("H121", "P2", 200, sources=("wafv2", "waf", "waf-regional", "shield", "cloudfront", "apigateway", "network-firewall"), actions=("UpdateWebACL", "DeleteWebACL", "UpdateRuleGroup", "DeleteRuleGroup", "PutLoggingConfiguration", "DeleteLoggingConfiguration", "DeleteProtection", "DeleteProtectionGroup", "DisableProactiveEngagement", "DisassociateDRTRole", "DisassociateDRTLogBucket", "UpdateDistribution", "UpdateStage", "DeleteFirewall", "DeleteFirewallPolicy", "UpdateFirewallPolicy", "DisassociateSubnets", "DeleteSubscription"), request={"resource_name": "name", "protection_id": "protectionId", "distribution_id": "id", "firewall_name": "firewallName"}),
    RowHunt("H131", "P1", 100, sources=("iam",), actions=("CreateAccessKey", "PutUserPolicy", "AttachUserPolicy", "AddUserToGroup", "CreateLoginProfile", "UpdateLoginProfile", "PutRolePolicy", "AttachRolePolicy", "UpdateAssumeRolePolicy", "PutUserPermissionsBoundary", "DeleteUserPermissionsBoundary"), request={"policy_arn": "policyArn", "group_name": "groupName"}, condition="endswith(user_identity_arn, '/' || coalesce(get_json_object(request_parameters, '$.userName'), get_json_object(request_parameters, '$.roleName')))"),
    RowHunt("H133", "P4", 200, condition="read_only is not true and (lower(session_credential_from_console) = 'true' or get_json_object(additional_event_data, '$.credentialId') is not null or contains(user_agent, 'console.aws.amazon.com') or contains(user_agent, 'signin.amazonaws.com'))"),
    RowHunt("H138", "P2", 200, sources=("codebuild", "codepipeline", "codedeploy", "codestar-connections"), actions=("CreateProject", "UpdateProject", "StartBuild", "BatchDeleteBuilds", "DeleteProject", "CreatePipeline", "UpdatePipeline", "StartPipelineExecution", "DeletePipeline", "CreateDeploymentGroup", "UpdateDeploymentGroup", "CreateDeployment", "DeleteDeploymentGroup", "CreateConnection", "UpdateConnection", "DeleteConnection")),
    RowHunt("H139", "P2", 100, actions=("CreateStack", "UpdateStack", "DeleteStack", "CreateChangeSet", "ExecuteChangeSet"), request={"stack_name": "stackName"}),
]

HUNTS = {h.id: h for h in ALL}


def bulk(events: DataFrame) -> DataFrame:
    """O-41: label, severity and hits of every row hunt, in one pass over the table."""
    return S.bulk_counts(events, {h.id: (h.severity, F.coalesce(h.where(), F.lit(False))) for h in HUNTS.values()})


def every_hit(events: DataFrame) -> DataFrame:
    """(hunt, event_id, hit): each row that a hunt hits, with the hunt's columns as one text, from one scan.

    A row is repeated for each hunt that it hits, in one generator, which tries a hunt's services and actions first.
    """
    shown = lambda h: F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("-")) for c in [*(F.col(k) for k in KEEP if k != "event_id"), *(F.get_json_object(c, p) for c, p in h.paths.values())]))
    hits = [F.when(h.where(), F.struct(F.lit(h.id).alias("hunt"), shown(h).alias("hit"))) for h in HUNTS.values()]
    return events.select("event_id", F.inline(F.array_compact(F.array(*hits)))).select("hunt", "event_id", "hit")
